"""Personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IP addresses, card and phone numbers: leftmost, without overlaps within a kind, in time
linear in the text. The field adds spans that no rule matches but whose words look alike, stand beside or repeat
personal data of the same document: a phone number without its country code, a card number with other marks, the name of an address without its host. Its nodes are the words with a digit or an @, and the words that repeat the name
of an address; all other words are no personal data and count as features of their neighbours only. Keys that tie words
together are the letters and digits of a word, the name of an address, and the last seven digits.

It is trained here, on all documents: the rules' spans are the labels, and where a word is repeated the form of
all but the first is hidden, so weights for agreeing are learned from what repeats; a word that no rule covers but
that shares a key with one that is covered teaches nothing. One pass over the texts
writes spans and nodes to the shared folder, a small part of the input; each step of learning reads only that table and sums
gradients by weight, and the last pass labels it. No row moves between tasks, so copies, long texts and common words
make no hot task; the weights (``FEATURES`` x 5) are all that tasks receive.

A span is added where the field gives its words the same kind with ``SURE`` probability and no rule's span
touches them; side by side words become one span, without marks at its ends. Offsets are code points.

Defined results: null texts count as empty and have no spans; repeated rows get the same result; ties need no rule,
as spans of a kind never overlap and kinds are listed in order; an empty table gives no rows; without any personal
data in the corpus the field adds nothing; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kithgraph.llm.common import BLANK_CHARS, materialize, table
from kithgraph.llm.skip_chain import Graph, Resilient, Weights, gradient, infer

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
LABELS = len(KINDS) + 1
FEATURES, SLOTS = 2048, 8
STEPS = 24
SURE = 0.7
#: Characters before and after a word that its neighbours are looked for in.
BESIDE = 40
LEAST_KEY, LEAST_DIGITS = 5, 7

LOCAL = "A-Za-z0-9._%+-"
EMAIL = re.compile(rf"[{LOCAL}]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_FROM_RUN = re.compile(rf"(?<![{LOCAL}])" + EMAIL.pattern)
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
BLANK = re.compile(r"[\x20\x09-\x0D]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOT_DIGIT, NOT_ALNUM = re.compile(r"[^0-9]"), re.compile(r"[^a-z0-9]")
NAME, NUMBER = (re.compile("[A-Za-z0-9]"),) * 2, (re.compile("[0-9+(]"), re.compile("[0-9]"))
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]{9,}")


def passes_luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(2 * v - 9 * (v > 4) for v in map(int, digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches begin where a run of name characters does, or where the last match ended."""
    end = 0
    while found := EMAIL.match(text, end) or EMAIL_FROM_RUN.search(text, end):
        yield found.span()
        end = found.end()


def small_parts(address: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in address.split(".")))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end of the rules' spans, by start, then kind."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := NOT_DIGIT.sub("", m.group())) <= 19 and passes_luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(found)


# --- nodes ---------------------------------------------------------------------------------------------------------


def marked_words(text: str) -> list[tuple[int, int]]:
    """Words with a digit or an @, and words equal to the name of an address but for marks and case."""
    found, end = [], 0
    while mark := MARK.search(text, end):
        start = 1 + max(end - 1, *(text.rfind(blank, end, mark.start()) for blank in BLANK_CHARS))
        stop = BLANK.search(text, mark.end())
        end = stop.start() if stop else len(text)
        found.append((start, end))
    names = {name for a, b in found if "@" in text[a:b] and len(name := alnum(text[a:b].partition("@")[0])) >= LEAST_KEY}
    if names:
        found = sorted({*found, *(m.span() for m in WORD.finditer(text) if alnum(m.group()) in names)})
    return found


def alnum(word: str) -> str:
    return NOT_ALNUM.sub("", word.lower())


def number(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def shape(word: str) -> str:
    """Letters as a, digits as 0 and one mark for a long run of them, other characters as they are."""
    return re.sub("[0-9]", "0", DIGITS.sub(lambda m: f"<{min(20, len(m.group()))}>", LETTERS.sub("a", word[:200])))[:30]


def own_check(word: str, run: str) -> str:
    """How a word, or the digits of the words side by side with it, is built like one of the kinds; empty if it is not."""
    digits = NOT_DIGIT.sub("", word if word.isdigit() and len(word) >= 14 else run)
    quad = IP.search(word)
    parts = ("@" in word and bool(EMAIL.search(word[:2000])), quad is not None and small_parts(quad.group()), 14 <= len(digits) <= 19 and (1 + passes_luhn(digits)), word.startswith("+"))
    return f"c{[int(p) for p in parts]}" if any(parts) else ""


def nodes_of(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list]:
    """The words' places without marks (as a name, as a number), whether each stands right after the one before, features, two keys (0: none), label."""
    words = marked_words(text)
    beside = [i > 0 and not text[words[i - 1][1] : a].strip(BLANK_CHARS) for i, (a, _) in enumerate(words)]
    runs, first = [], 0
    for i in range(1, len(words) + 1):
        if i == len(words) or not beside[i] or not (plain_number(text, words[i - 1]) and plain_number(text, words[i])):
            runs += [(words[first][0], words[i - 1][1])] * (i - first)
            first = i
    out: dict[str, list] = {"places": [], "beside": beside, "features": [], "keys": [], "label": []}
    at = 0
    for (a, b), (low, high) in zip(words, runs, strict=True):
        word = text[a:b]
        before, after = text[max(0, a - BESIDE) : a].split(), text[b : b + BESIDE].split()
        digits, marks = NOT_DIGIT.sub("", word), "".join(m for m in "@.-+():=/#$\"'" if m in word)
        beside_it = ("bias", f"<{shape(before[-1])}" if before else "<", f">{shape(after[0])}" if after else ">", f"<<{before[-1].lower()}" if before else "<<")
        check = own_check(word, text[low : min(high, low + BESIDE)])
        own = (f"s{shape(word)}", f"n{min(20, len(digits))}" if digits else "", f"m{marks}" if marks else "", check)
        name, sign, _ = word.partition("@")
        keys = (alnum(name), digits[-LEAST_DIGITS:] if len(digits) >= LEAST_DIGITS else alnum(word) if sign else "")
        keys = [zlib.crc32(k.encode()) + 1 if len(k) >= LEAST_KEY else 0 for k in keys]
        out["places"] += (*inner(NAME, word, a, b), *inner(NUMBER, word, a, b))
        out["features"] += (number(name) if name else -1 for name in (*beside_it, *own))
        out["keys"] += keys if keys[0] != keys[1] else (keys[0], 0)
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        label, most = NONE, 0
        for s, kind, e in spans_near(spans, at, b):
            if (common := min(b, e) - max(a, s)) > most:
                label, most = kind, common
        out["label"].append(label)
    return out


def inner(pattern: tuple[re.Pattern, re.Pattern], word: str, a: int, b: int) -> tuple[int, int]:
    """Where the part of a word between its first and last character of a pattern stands."""
    first, last = pattern[0].search(word), pattern[1].search(word[::-1])
    return (a + first.start(), b - last.start()) if first and last else (a, b)


def spans_near(spans: list[tuple[int, int, int]], at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Spans from the one at ``at`` on that begin before ``end``."""
    for span in spans[at:]:
        if span[0] >= end:
            return
        yield span


def plain_number(text: str, word: tuple[int, int]) -> bool:
    return word[1] - word[0] <= 40 and not NOT_DIGIT.search(text[word[0] : word[1]].replace("-", ""))


# --- passes --------------------------------------------------------------------------------------------------------

LISTS = {"spans": pa.int32(), "places": pa.int32(), "beside": pa.bool_(), "features": pa.int32(), "keys": pa.int64(), "label": pa.int32()}
GRAPHS = "doc_id long, spans array<int>, places array<int>, beside array<boolean>, features array<int>, keys array<long>, label array<int>"


def graphs(docs: DataFrame) -> DataFrame:
    """The rules' spans and the nodes of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {name: [] for name in LISTS}
            for text in batch.column(1):
                text = text.as_py() or ""
                marked = MARK.search(text) is not None
                spans = base_spans(text) if marked else []
                for name, values in (nodes_of(text, spans) if marked else dict.fromkeys(found, ())).items():
                    found[name].append(values)
                if marked:
                    found["spans"].append([x for span in spans for x in span])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[n], pa.list_(kind)) for n, kind in LISTS.items())], names=["doc_id", *LISTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, GRAPHS)


def graph_of(batch: pa.RecordBatch) -> tuple[Graph, np.ndarray, np.ndarray]:
    """One graph of all documents of a batch, the labels, and the number of nodes of each document."""
    part = {name: batch.column(name) for name in LISTS}
    flat = {name: column.flatten().to_numpy(zero_copy_only=False) for name, column in part.items()}
    counts = np.array([len(x) for x in part["label"]], dtype=np.int64)
    keys = flat["keys"].reshape(-1, 2)
    member, slot = np.nonzero(keys)
    _, key, often = np.unique((np.repeat(np.arange(len(counts)), counts)[member] << 33) | keys[member, slot], return_inverse=True, return_counts=True)
    shared = often[key] > 1
    _, key = np.unique(key[shared], return_inverse=True)
    second = np.flatnonzero(flat["beside"])
    return Graph(flat["features"].reshape(-1, SLOTS).astype(np.int64), np.stack([second - 1, second], axis=1), member[shared], key), flat["label"].astype(np.int64), counts


def learn(marked: DataFrame, steps: int = STEPS) -> np.ndarray:
    """Weights from the labels of all graphs; a step brings FEATURES * LABELS sums to the driver at most."""
    own = Resilient(FEATURES, LABELS)

    def gather(flat: np.ndarray):
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(flat)
            for batch in batches:
                if batch.num_rows:
                    graph, label, _ = graph_of(batch)
                    total += gradient(graph.to_learn(label, NONE), label, Weights(flat, FEATURES, LABELS))
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["place", "total"])

        return add

    for _ in range(steps):
        rows = marked.mapInArrow(gather(own.weights), "place long, total double").groupBy("place").agg(F.sum("total").alias("total")).collect()
        grad = np.zeros(len(own.weights))
        for row in rows:
            grad[row.place] = row.total
        own.move(grad)
    return own.weights


def added_spans(places: np.ndarray, beside: np.ndarray, kinds: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of nodes that have a kind; neighbours of one kind are one span."""
    found: list[tuple[int, int, int]] = []
    last = -2
    for i in np.flatnonzero(kinds != NONE):
        kind, own = int(kinds[i]), places[i, :2] if kinds[i] == 0 else places[i, 2:]
        if last == i - 1 and beside[i] and found[-1][1] == kind and kind:
            found[-1] = (found[-1][0], kind, int(own[1]))
        else:
            found.append((int(own[0]), kind, int(own[1])))
        last = i
    return found


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def label(found: DataFrame, flat: np.ndarray) -> DataFrame:
    """doc_id, number of the rules' spans by kind, those spans, and all spans with the field's."""

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            graph, known, counts = graph_of(batch)
            node, _, _ = infer(graph, Weights(flat, FEATURES, LABELS))
            kinds = np.where((known == NONE) & (node.max(axis=1, initial=0) >= SURE), node.argmax(axis=1), NONE) if len(node) else known
            places = batch.column("places").flatten().to_numpy().reshape(-1, 4)
            beside = batch.column("beside").flatten().to_numpy(zero_copy_only=False)
            base, every, at = [], [], 0
            for flat_spans, n in zip(batch.column("spans"), counts.tolist(), strict=True):
                own = flat_spans.as_py()
                own = list(zip(own[::3], own[1::3], own[2::3], strict=True))
                more = added_spans(places[at : at + n], beside[at : at + n], kinds[at : at + n]) if n else []
                base.append(own)
                every.append(sorted(own + more))
                at += n
            columns = [pa.array([sum(kind == k for _, k, _ in own) for own in base], pa.int64()) for kind in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(map(written, base), pa.string()), pa.array(map(written, every), pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return found.mapInArrow(results, FOUND)


def find(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, spans of every row of docs (doc_id, text)."""
    found = materialize(graphs(docs), "personal-data")
    marked = found.filter(F.size("label") > 0)
    return label(found, learn(marked, steps))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
