"""Self-join of documents on the Jaccard similarity of their word n-gram sets.

The join follows vertical partitioning. All n-grams have one global order: rarest first, then by hash. For
that, n-grams are dealt by hash to tasks, which count in how many different sets each occurs and drop those of
a single set, which can't be shared. N-grams that a bounded sample shows in very many sets are not dealt to one
task but stay spread over the sets' own parts; they come last in the order. Sets whose rare n-grams alone
forbid a link stop there. The others meet at the n-grams of their prefixes, under the positional bound. The
global order is cut into fragments, a pair's overlap is counted in each fragment apart, and the counts are
summed per pair.

Equal sets are one node. Pairs inside a component that is already connected need no check, so large groups
of near copies cost one pair a member: rounds pair each node with one leader of another component, and an
exact join of what is left over components closes the gap. No cap is set on partners.

Defined results: documents without words (null and empty texts too) have an empty set and link with nothing;
their component is their own doc_id, null if that is null. Null doc_ids never are a component's id unless
all are. Repeated rows are equal sets. An empty table gives no rows. Extra columns are ignored. Sets are
told apart by 64-bit hashes, n-grams by 48 bits and their task's number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kithgraph.llm import textscan as ts
from kithgraph.llm.common import materialize, table
from kithgraph.llm.components import components

WORDS = 5
PERCENT = 80
#: N-grams that a fragment holds on average; a task sorts one fragment.
FRAGMENT_GRAMS = 1 << 21
LEAST_FRAGMENTS, MOST_BITS = 64, 24
#: Leaders that a set is compared with in a round, and rounds before the exact join takes what is left.
TRIES, ROUNDS = 3, 8
#: Where the global order is cut: frequencies at which a fragment begins, and fragments of equal parts of the hash range there.
CUTS = ((2, 4), (3, 2), (4, 1), (8, 1), (64, 1))
PIECES = sum(parts for _, parts in CUTS)
#: N-grams of the sample in which common ones are looked for, and the least number of sets that makes one common.
SAMPLE_GRAMS, COMMON = 1 << 23, 32
#: Frequency of a common n-gram, and the greatest that is told apart.
MOST = 65535
#: The largest components, whose rows meet their component by a broadcast.
LARGEST = 4096


def gram_sets(batch_column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and sorted distinct n-gram hashes of each text, A-Z lower-cased."""
    data, offsets = ts.string_buffers(batch_column)
    for low, high in ts.slices(offsets):
        part, own = ts.lower_ascii(data[offsets[low] : offsets[high]]), offsets[low : high + 1] - offsets[low]
        starts, ends, rows = ts.word_spans(part, own)
        sums = ts.prefix_sums(ts.span_hashes(ts.byte_sums(part), starts, ends))
        at = np.arange(max(0, len(starts) - n + 1))
        grams = ts.span_hashes(sums, at, at + n)
        bounds = np.searchsorted(rows, np.arange(high - low + 1))
        for i, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if last - first >= n:
                yield low + i, np.unique(grams[first : last - n + 1])
            elif last > first:
                yield low + i, ts.span_hashes(sums, np.array([first]), np.array([last]))
            else:
                yield low + i, grams[:0]


def set_node(grams: np.ndarray) -> int:
    return int(ts.mix(np.array([ts.mix(grams).sum(), len(grams)], dtype=np.uint64) * np.uint64(ts.MULTIPLIER)).sum().view(np.int64))


def profile(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, n_shingles and node (the set's hash; null for the empty set) of each row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes = [0] * batch.num_rows, [None] * batch.num_rows
            for row, grams in gram_sets(batch.column(1), n):
                if len(grams):
                    sizes[row], nodes[row] = len(grams), set_node(grams)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64())], names=["doc_id", "text_key", "n_shingles", "node"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(scan, "doc_id long, text_key long, n_shingles long, node long")


def common_grams(docs: DataFrame, n: int, total: int) -> np.ndarray:
    """The sorted n-grams that at least COMMON sets of a sample hold: SAMPLE_GRAMS / COMMON at most, whatever the corpus.

    They only decide where an n-gram is counted and that it comes last in the order; any choice gives the same links.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held = []
        for batch in batches:
            for _, grams in gram_sets(batch.column(0), n):
                if len(grams) and (node := set_node(grams)) not in seen:
                    seen.add(node)
                    held.append(grams)
        if held:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(times)], names=["gram", "n"])

    share = max(1, -(-total // SAMPLE_GRAMS))
    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text")
    found = sample.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)
    return np.sort(np.asarray(found.select("gram").toArrow().column(0).combine_chunks()).view(np.uint64))


PACKED = "nodes binary, sizes binary, counts binary, grams binary, often binary"


def packed(key: str, keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, grams: np.ndarray, often: np.ndarray | None, rows_of: np.ndarray | None = None) -> pa.RecordBatch:
    """Postings dealt by key: a row for each key, with runs of equal nodes (or of rows_of) written once."""
    order = np.argsort(keys, kind="stable")
    same = (nodes if rows_of is None else rows_of)[order]
    keys, nodes, sizes, grams = keys[order], nodes[order], sizes[order], grams[order]
    often = often[order] if often is not None else None
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    rows: list[list] = [[] for _ in range(6)]
    for low, high in zip(edges, np.append(edges[1:], len(keys))[: len(edges)], strict=True):
        own, run = nodes[low:high], same[low:high]
        first = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
        values = (int(keys[low]), own[first].tobytes(), sizes[low:high][first].astype("<u4").tobytes(), np.diff(np.append(first, high - low)).astype("<u4").tobytes())
        # A fragment's n-grams are told apart by 48 bits.
        short = grams[low:high].view(np.uint8).reshape(-1, 8)[:, :6].tobytes() if often is None else grams[low:high].tobytes()
        for column, x in zip(rows, (*values, short, b"" if often is None else often[low:high].tobytes()), strict=True):
            column.append(x)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=[key, "nodes", "sizes", "counts", "grams", "often"])


def unpacked(group: pa.Table, short: bool, often: str = "<u2") -> tuple[np.ndarray, ...]:
    def joined(name: str, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(group.column(name).to_pylist()), dtype=kind)

    counts = joined("counts", "<u4")
    nodes, sizes = joined("nodes", "<i8"), joined("sizes", "<u4").astype(np.int64)
    if not short:
        return nodes, sizes, counts, joined("grams", "<u8"), joined("often", often)
    raw = joined("grams", "u1").reshape(-1, 6)
    grams = np.zeros((len(raw), 8), dtype=np.uint8)
    grams[:, :6] = raw
    return nodes, sizes, counts, grams.view("<u8").ravel(), np.zeros(0, "<u2")


def fragments(docs: DataFrame, n: int, bits: int, common) -> DataFrame:
    """Every set's n-grams dealt to 2**bits parts of the hash range, common ones by set; a task hands a set on once."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held, size = [], 0

            def out(held: list) -> Iterator[pa.RecordBatch]:
                lengths = [len(x) for _, x in held]
                nodes = np.repeat(np.array([x for x, _ in held], np.int64), lengths)
                grams, sizes = np.concatenate([x for _, x in held]), np.repeat(lengths, lengths)
                known = common.value
                often = known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams if len(known) else np.zeros(len(grams), dtype=bool)
                for own, route in ((~often, grams), (often, ts.mix(nodes.view(np.uint64)))):
                    keys = (route[own] >> np.uint64(64 - bits)).astype(np.int32)
                    yield packed("fragment", keys, nodes[own], sizes[own], grams[own], None if route is grams else np.full(len(keys), MOST, "<u2"))

            for _, grams in gram_sets(batch.column(0), n):
                node = set_node(grams)
                if not len(grams) or node in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                held.append((node, grams))
                size += len(grams)
                if size > 1_000_000:
                    yield from out(held)
                    held, size = [], 0
            if held:
                yield from out(held)

    return docs.select("text").mapInArrow(scan, f"fragment int, {PACKED}")


def shared_grams(dealt: DataFrame, bits: int, buckets: int) -> DataFrame:
    """The n-grams of each fragment that occur in several sets, dealt by set, with their frequencies."""

    def first_sending(nodes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The entries of the first task that handed on a set; others sent the same."""
        _, first = np.unique(nodes, return_index=True)
        once = np.zeros(len(nodes), dtype=bool)
        once[first] = True
        return np.repeat(once, counts)

    def count(group: pa.Table) -> pa.Table:
        fragment = group.column("fragment")[0].as_py()
        by_set = pa.compute.greater(pa.compute.binary_length(group.column("often")), 0)
        nodes, sizes, counts, grams, _ = unpacked(group.filter(pa.compute.invert(by_set)), True)
        keep = first_sending(nodes, counts)
        grams, owner = grams[keep], np.repeat(np.arange(len(nodes)), counts)[keep]
        order = np.argsort(grams, kind="stable")
        grams, owner = grams[order], owner[order]
        edges = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
        runs = np.diff(np.append(edges, len(grams)))
        often = np.repeat(runs, runs)
        keep = often > 1
        grams, owner, often = grams[keep] | np.uint64(fragment << (64 - bits)), owner[keep], np.minimum(often[keep], MOST - 1).astype("<u2")
        more_nodes, more_sizes, counts, more_grams, most = unpacked(group.filter(by_set), False)
        keep = first_sending(more_nodes, counts)
        owner = np.append(owner, np.repeat(np.arange(len(more_nodes)), counts)[keep] + len(nodes))
        nodes, sizes = np.append(nodes, more_nodes), np.append(sizes, more_sizes)
        grams, often = np.append(grams, shortened(more_grams[keep], bits)), np.append(often, most[keep])
        order = np.argsort(owner, kind="stable")
        grams, owner, often = grams[order], owner[order], often[order]
        keys = (nodes[owner] % buckets).astype(np.int32)
        return pa.Table.from_batches([packed("bucket", keys, nodes[owner], sizes[owner], grams, often)])

    return dealt.groupBy("fragment").applyInArrow(count, f"bucket int, {PACKED}")


def shortened(grams: np.ndarray, bits: int) -> np.ndarray:
    """The bits by which n-grams are told apart: those of the task's number and the lower 48."""
    return grams & np.uint64((((1 << bits) - 1) << (64 - bits)) | ((1 << 48) - 1))


def prefix_length(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100.0) + 1


def candidates(shared: DataFrame, percent: int) -> DataFrame:
    """node, size, alone (n-grams of no other set) and shared n-grams, cut along the global order, for sets that may link."""

    def gather(group: pa.Table) -> pa.Table:
        nodes, sizes, counts, grams, often = unpacked(group, False)
        owner = np.repeat(nodes, counts)
        size = np.repeat(sizes, counts)
        order = np.lexsort((grams, often, owner))
        owner, size, grams, often = owner[order], size[order], grams[order], often[order]
        edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
        runs = np.diff(np.append(edges, len(owner)))
        n, alone = size[edges], size[edges] - runs
        keep = alone < n - -(-n * percent // 100) + 1
        own = np.repeat(keep, runs)
        key = np.repeat(np.arange(keep.sum()) * PIECES, runs[keep]) + fragment_of(often[own], grams[own])
        inner = np.searchsorted(key, np.arange(keep.sum() * PIECES + 1))
        lists = pa.ListArray.from_arrays(pa.array(inner, pa.int32()), pa.array(grams[own].view(np.int64)))
        pieces = pa.ListArray.from_arrays(pa.array(np.arange(keep.sum() + 1) * PIECES, pa.int32()), lists)
        return pa.table({"node": pa.array(owner[edges][keep]), "size": pa.array(n[keep]), "alone": pa.array(alone[keep]), "pieces": pieces})

    return shared.groupBy("bucket").applyInArrow(gather, "node long, size long, alone long, pieces array<array<long>>")


def fragment_of(often: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The fragment of the global order (frequency, then hash) in which each n-gram lies; it never falls along the order."""
    out, before = np.zeros(len(grams), np.int64), 0
    for begin, parts in CUTS:
        here = often >= begin
        out[here] = before + (grams[here] >> np.uint64(32)) * np.uint64(parts) // np.uint64(1 << 32)
        before += parts
    return out


def can_link(a: str, b: str, percent: int) -> Column:
    """The positional bound: what two sets can still share from these places on allows the similarity."""
    col = F.col
    most = F.least(col(f"{a}.size") - col(f"{a}.place"), col(f"{b}.size") - col(f"{b}.place"))
    return most * (100 + percent) >= (col(f"{a}.size") + col(f"{b}.size")) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The labels (a, b) of the pairs of sets that link: overlaps counted by fragment and summed per pair."""
    pieces = sets.select("node", "size", F.posexplode("pieces").alias("fragment", "grams")).filter(F.size("grams") > 0)
    left = pieces.select(F.col("node").alias("a"), F.col("size").alias("size_a"), "fragment", F.col("grams").alias("grams_a"))
    right = pieces.select(F.col("node").alias("b"), F.col("size").alias("size_b"), "fragment", F.col("grams").alias("grams_b"))
    both = pairs.join(left, "a").join(right, ["b", "fragment"])
    first = [F.first(name).alias(name) for name in ("size_a", "size_b", "label_a", "label_b")]
    total = both.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("grams_a", "grams_b"))).alias("overlap"), *first)
    linked = total.filter(F.col("overlap") * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent)
    return linked.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))


def largest_labels(labels: DataFrame) -> DataFrame:
    """label, members of the largest components, LARGEST rows at most."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("members")).filter("members > 1")
    return materialize(sizes.orderBy(F.col("members").desc(), "label").limit(LARGEST), "largest")


def with_values(rows: DataFrame, values: DataFrame, largest: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with values by label. The largest components' rows stay where they are and get theirs by a broadcast."""
    crowd = F.broadcast(largest.select("label"))
    hot = rows.join(crowd, "label", "left_semi").join(F.broadcast(values.join(crowd, "label", "left_semi")), "label", how)
    return hot.unionByName(rows.join(crowd, "label", "left_anti").join(values, "label", how))


def linked(sets: DataFrame, percent: int) -> DataFrame:
    """node, label for every candidate set: its component among all links."""
    sets = materialize(sets, "sets")
    prefix = materialize(
        sets.select("node", "size", "alone", F.posexplode(F.slice(F.flatten("pieces"), F.lit(1), (prefix_length(F.col("size"), percent) - F.col("alone")).cast("int"))).alias("i", "gram"))
        .select("gram", "node", "size", "alone", (F.col("alone") + F.col("i")).alias("place")),
        "prefix",
    )
    labels = sets.select("node", F.col("node").alias("label"))
    rounds = 0
    while True:
        if rounds:
            # How large a component is only decides who leads; beyond the largest, all count alike.
            labels_now = labels.join(F.broadcast(largest_labels(labels)), "label", "left").select("node", "label", F.coalesce("members", F.lit(1)).alias("members"))
            placed = prefix.join(labels_now, "node")
        else:
            placed = prefix.withColumn("label", F.col("node")).withColumn("members", F.lit(1).cast("long"))
        # First the set with the fewest n-grams of its own leads, later any set of the largest component.
        chance = F.xxhash64("node", "gram", F.lit(rounds))
        order = F.struct(-F.col("members"), (F.col("alone") if rounds == 0 else chance).alias("turn"), chance.alias("chance"), "node", "size", "place", "alone", "label")
        leaders = placed.groupBy("gram").agg(F.min(order).alias("o")).select("gram", "o.label", "o.node", "o.size", "o.place", "o.alone")
        met = placed.alias("x").join(leaders.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label")) & can_link("x", "y", percent))
        votes = met.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b")).agg(F.count("*").alias("n"), F.min("y.alone").alias("alone"), F.first("x.label").alias("label_a"), F.first("y.label").alias("label_b"))
        best = W.partitionBy("a").orderBy(F.col("n").desc() if rounds == 0 else F.col("alone"), "alone", "b")
        pairs = votes.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= TRIES).select("a", "b", "label_a", "label_b")
        new, labels = joined(verified(pairs, sets, percent), labels)
        rounds += 1
        if not new or rounds == ROUNDS:
            break
    # What is left: pairs of different components; one of them is outside the n-gram's largest component.
    placed = materialize(prefix.join(labels, "node"), "placed")
    main = placed.groupBy("gram", "label").agg(F.count("*").alias("n")).groupBy("gram").agg(F.max(F.struct("n", "label")).alias("m"), F.count("*").alias("labels"))
    main = main.filter("labels > 1").select("gram", F.col("m.label").alias("main"))
    rest = placed.join(main, "gram")
    x, y = rest.filter("label <> main").alias("x"), rest.alias("y")
    different = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
    pairs = x.join(y, different & can_link("x", "y", percent)).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.label").alias("label_a"), F.col("y.label").alias("label_b")).distinct()
    return joined(verified(pairs, sets, percent), labels)[1]


def joined(links: DataFrame, labels: DataFrame) -> tuple[bool, DataFrame]:
    """Whether there were links (a, b) of labels, and the labels with the links' components merged."""
    edges = materialize(links.distinct(), "links")
    if edges.isEmpty():
        return False, labels
    merged = components(edges).select(F.col("node").alias("label"), F.col("label").alias("new"))
    moved = with_values(labels, merged, largest_labels(labels), "left")
    return True, materialize(moved.select("node", F.coalesce("new", "label").alias("label")), "labels")


def jaccard_components(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, labelled: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs; if ``labelled``, also text_key and label.

    label tells components apart where doc_ids can't (null or repeated ones); it is null for the empty set.
    """
    rows = materialize(profile(docs, n), "profile")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    bits = max(LEAST_FRAGMENTS.bit_length() - 1, min(MOST_BITS, int(total // FRAGMENT_GRAMS).bit_length()))
    common = docs.sparkSession.sparkContext.broadcast(common_grams(docs, n, total))
    shared = shared_grams(fragments(docs, n, bits, common), bits, 1 << bits)
    labels = linked(candidates(shared, percent), percent).filter("label <> node")
    found = rows.filter("node IS NOT NULL").join(labels, "node", "left").select("doc_id", "text_key", "n_shingles", F.coalesce("label", "node").alias("label"))
    found = materialize(found, "labelled")
    smallest = found.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    alone = rows.filter("node IS NULL").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("label"))
    out = with_values(found, smallest, largest_labels(found)).unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", *(("text_key", "label") if labelled else ()))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT DISTINCT r, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS gram
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM g GROUP BY r
), u AS (SELECT r, md5(string_agg(gram, ' | ' ORDER BY gram)) AS body FROM g GROUP BY r
), f AS (SELECT body, min(r) AS head FROM u GROUP BY body
), i AS (SELECT gram, list(r) AS rs FROM g SEMI JOIN f ON g.r = f.head GROUP BY gram HAVING count(*) > 1
), pr AS (SELECT a.r AS a, b AS b, count(*) AS common FROM (SELECT unnest(rs) AS r, rs FROM i) a, unnest(a.rs) AS t(b) WHERE a.r < b GROUP BY 1, 2
), links AS (SELECT a, b FROM pr JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links UNION ALL SELECT r, head FROM u JOIN f USING (body) UNION ALL SELECT head, r FROM u JOIN f USING (body)
), walk(r, m) AS (SELECT r, r FROM d UNION SELECT walk.r, edges.b FROM walk JOIN edges ON edges.a = walk.m)
SELECT any_value(d.doc_id) AS doc_id, coalesce(any_value(n), 0)::bigint AS n_shingles, min(e.doc_id) AS component_id
FROM walk JOIN d ON d.r = walk.r JOIN d e ON e.r = walk.m LEFT JOIN n ON n.r = walk.r GROUP BY walk.r
"""
