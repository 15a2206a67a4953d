"""Personal data: the rules against plain regular expressions, the field against all labellings."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from kithgraph.llm import personal_data as pd
from kithgraph.llm import skip_chain as sc

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    def good(kind, x):
        digits = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            double = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in double) % 10 == 0
        return kind == "email" or 10 <= len(digits) <= 15

    return sorted((m.start(), i, m.end()) for i, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(kind, m.group()))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "é", ".", "@", "-", "+", "_", "(", ")", " ", "0", "7", "25", "256", "4111 1111 1111 1111", "5105105105105100", "a.b@c.d", "x@y", "1.2.3.4", "+1 (068) 555-2748", "\n"]), max_size=14).map("".join))
def test_rules_equal_plain_expressions(text):
    assert pd.base_spans(text) == plain(text)


def test_rules_take_time_in_proportion_to_the_text():
    for unit in ("a", "1", "1.", "a@", "+1", "+1(", "1 ", "a.b@c-"):
        text = unit * (400_000 // len(unit))
        assert len(pd.base_spans(text)) >= 0
        assert len(pd.marked_words(text)) <= len(text)


def exact(graph, weights, labels):
    """Marginals of nodes and the logarithm of the sum over all labellings of nodes and keys."""
    n, k = len(graph.features), int(graph.key.max(initial=-1)) + 1
    total, node = 0.0, np.zeros((n, labels))
    for y in itertools.product(range(labels), repeat=n + k):
        own = y[:n]
        score = sum(weights.features[f, own[i]] for i, row in enumerate(graph.features) for f in row if f >= 0)
        score += sum(weights.beside[own[i], own[j]] for i, j in graph.chain)
        score += sum(weights.agree[own[i]] for i, j in zip(graph.member, graph.key, strict=True) if own[i] == y[n + j])
        total += np.exp(score)
        for i, v in enumerate(own):
            node[i, v] += np.exp(score)
    return node / total, np.log(total)


def example(chain, keys, features=4, labels=3):
    rng = np.random.default_rng(4)
    member, key = np.array([m for m, _ in keys], dtype=np.int64), np.array([k for _, k in keys], dtype=np.int64)
    graph = sc.Graph(np.array([[0, 1, -1], [2, -1, 3], [1, 3, 2], [0, -1, -1]]), np.array(chain, dtype=np.int64).reshape(-1, 2), member, key)
    return graph, sc.Weights(rng.normal(size=sc.Weights.size(features, labels)), features, labels)


def test_messages_give_exact_marginals_on_trees_and_close_ones_on_loops():
    for chain, keys, error in (([(0, 1), (1, 2)], [], 1e-4), ([(0, 1)], [(1, 0), (2, 0), (3, 0)], 1e-4), ([(0, 1), (1, 2), (2, 3)], [(0, 0), (3, 0)], 0.05)):
        graph, weights = example(chain, keys)
        assert np.abs(sc.infer(graph, weights)[0] - exact(graph, weights, 3)[0]).max() < error


def test_gradient_is_the_slope_of_the_likelihood():
    graph, weights = example([(0, 1), (2, 3)], [(0, 0), (2, 0)])
    label = np.array([1, 0, 1, 2])

    def likelihood(flat):
        w = sc.Weights(flat, 4, 3)
        score = sum(w.features[f, label[i]] for i, row in enumerate(graph.features) for f in row if f >= 0) + w.beside[1, 0] + w.beside[1, 2] + 2 * w.agree[1]
        return score - exact(graph, w, 3)[1]

    got = sc.gradient(graph, label, weights)
    for at in range(len(got)):
        near = weights.flat.copy()
        near[at] += 1e-5
        assert abs((likelihood(near) - likelihood(weights.flat)) / 1e-5 - got[at]) < 2e-3


def test_a_key_with_many_words_costs_messages_not_pairs():
    n = 50_000
    graph = sc.Graph(np.zeros((n, 1), dtype=np.int64), np.zeros((0, 2), dtype=np.int64), np.arange(n), np.zeros(n, dtype=np.int64))
    node, _, shared = sc.infer(graph, sc.Weights(np.ones(sc.Weights.size(1, 2)), 1, 2))
    assert len(shared) == n and np.allclose(node, 0.5)


def corpus():
    rng = np.random.default_rng(9)
    words = "the of and note call mail sent by then about list order page item".split()

    def filler(n):
        return " ".join(rng.choice(words, n))

    def luhn(rest):
        return next(rest + str(d) for d in range(10) if pd.passes_luhn(rest + str(d)))

    docs = []
    for i in range(240):
        area, line = rng.integers(200, 999), rng.integers(1000, 9999)
        phone, mail = f"+1 ({area}) 555-{line}", f"{rng.choice(words)}.{rng.choice(words)}{i}@mail{i % 7}.example.com"
        card, ip = luhn("".join(map(str, rng.integers(0, 10, 15)))), ".".join(map(str, rng.integers(0, 256, 4)))
        own = rng.choice([phone, mail, card, ip], 2, replace=False).tolist()
        decoy = next(d for d in map(str, rng.integers(10**15, 10**16, 50)) if not pd.passes_luhn(d))
        docs.append((i, f"{filler(3)} {decoy} {filler(2)} {decoy if i % 3 else ''} {filler(3)} {own[0]} {filler(5)} {own[1]} {filler(4)} {own[i % 2]} {filler(7)} version {i % 9}.0. in {1990 + i % 40}"))
    return docs


def test_the_field_adds_what_repeats_personal_data_and_leaves_the_rest(spark):
    texts = {
        1000: "call +1 (843) 555-4223 about the order and then 843-555-4223 again",
        1001: "mail sent by anna.note77@mail3.example.com then anna.note77 then list",
        1002: "order 7 of page 12 in 1999, version 2.0. of 14 items",
        1003: "the card 1234567890123456 of the order 1234567890123456",
        1004: "card 5105105105105100 then 5105/1051/0510/5100 then 5105105105105100",
    }
    rows = [*corpus(), *texts.items()]
    found = {r.doc_id: r for r in pd.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) == {i for i, _ in rows}
    for i, text in rows:
        assert found[i].base == pd.written(plain(text))
        assert set(filter(None, found[i].base.split(","))) <= set(found[i].spans.split(","))
        if i < 1000:
            assert found[i].spans == found[i].base
    assert found[1000].spans == "phone:5:22,phone:48:60"
    assert found[1001].spans == "email:13:42,email:48:59"
    assert found[1002].spans == found[1003].spans == ""
    assert found[1004].spans == "card:5:21,card:27:46,card:52:68" and found[1004].n_card == 2


def test_odd_rows(spark):
    rows = [(1, None), (None, "a@b.c"), (2, ""), (3, "x" * 50_000 + " 1.2.3.4"), (4, "a@b.c a@b.c"), (4, "a@b.c a@b.c"), (5, "é 日本 +1 (068) 555-2748\n9"), (6, "1 " * 20_000)]
    clash = ", ".join(f"{c} string" for c in ("spans", "base", "places", "keys", "label", "features", "n_email"))
    docs = spark.createDataFrame([(*r, *"x" * 7) for r in rows], f"doc_id long, text string, {clash}")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in pd.find(docs, 3).collect())
    want = Counter((i, *(sum(k == j for _, k, _ in plain(t)) for j in range(4)), pd.written(plain(t))) for i, t in rows)
    assert got == want and pd.find(docs.limit(0), 2).count() == 0
    nothing = spark.createDataFrame([(1, "no data 12"), (2, None)], "doc_id long, text string")
    assert [(r.base, r.spans) for r in pd.find(nothing, 3).collect()] == [("", "")] * 2


def test_query_on_its_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = pd.op11_personal_data(spark, DATA).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(docs))
    for r in rows:
        base = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pd.written(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]
        assert set(filter(None, pd.written(base).split(","))) <= set(r.spans.split(","))
