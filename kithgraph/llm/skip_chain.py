"""A skip-chain conditional random field over the marked words of documents.

Nodes are words, labels are small numbers. Potentials: one weight for each feature of a word and label; one for each
pair of labels of words that stand side by side; and, for words of a document that share a key (repeated or similar
words), one for agreeing on a label. Words with the same key share one latent label instead of an edge for each two
of them, so a key with n words costs n messages, not n * n. Messages pass along chains and keys until they stay (loopy
sum-product, damped, in logarithms); all documents of a batch pass theirs at once.

Weights are learned by resilient propagation: only the sign of a gradient's entry and whether it changed moves a
weight, so the order in which tasks add up their parts does not show in the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Most rounds of messages; fewer once none changes by more than SETTLED.
ROUNDS, SETTLED, DAMPING = 30, 1e-5, 0.3
#: Pull of the prior on weights of features and neighbours, and on those for agreeing, which few words speak for.
PRIOR, PRIOR_AGREE = 0.2, 0.004


@dataclass
class Graph:
    """features: nodes x slots (-1: none); chain: pairs of neighbours; member and key: equal lengths, keys from 0."""

    features: np.ndarray
    chain: np.ndarray
    member: np.ndarray
    key: np.ndarray

    def to_learn(self, label: np.ndarray, none: int) -> Graph:
        """The graph that weights are learned from.

        All but the first word of each key are known by their first slots only: what makes up a repeated word's own form
        is taken away, so that learning has to rely on the words it repeats. A word without a label that shares a
        key with a labelled one teaches nothing: whether it is personal data is what the field is to find out.
        """
        order = np.lexsort((self.member, self.key))
        later = order[1:][self.key[order][1:] == self.key[order][:-1]]
        labelled = np.bincount(self.key, label[self.member] != none, int(self.key.max(initial=-1)) + 1)
        open_ones = (label[self.member] == none) & (labelled[self.key] > 0)
        features = self.features.copy()
        features[self.member[later], KEPT_SLOTS:] = -1
        features[self.member[open_ones]] = -1
        return Graph(features, self.chain, self.member[~open_ones], self.key[~open_ones])


#: Slots that stay known where a word's form is hidden: bias and the words beside it.
KEPT_SLOTS = 4


class Weights:
    """Views of one flat vector: features x labels, labels x labels, labels."""

    def __init__(self, flat: np.ndarray, features: int, labels: int) -> None:
        self.flat, own, pair = flat, features * labels, labels * labels
        self.features = flat[:own].reshape(features, labels)
        self.beside = flat[own : own + pair].reshape(labels, labels)
        self.agree = flat[own + pair :]

    @staticmethod
    def size(features: int, labels: int) -> int:
        return features * labels + labels * labels + labels


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def normalised(x: np.ndarray) -> np.ndarray:
    return x - log_sum(x, -1)[..., None]


def add_at(target: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    for label in range(target.shape[1]):
        target[:, label] += np.bincount(at, values[:, label], len(target))


def infer(graph: Graph, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of nodes (n x L), of neighbours (e x L x L) and of words with their key's label (m x L x L)."""
    labels = len(weights.agree)
    known = graph.features >= 0
    own = (weights.features[np.where(known, graph.features, 0)] * known[..., None]).sum(axis=1)
    first, second = graph.chain[:, 0], graph.chain[:, 1]
    share = np.diag(weights.agree)
    keys = int(graph.key.max(initial=-1)) + 1
    right, left = np.zeros((len(first), labels)), np.zeros((len(first), labels))
    up, down = np.zeros((len(graph.key), labels)), np.zeros((len(graph.key), labels))

    def beliefs() -> np.ndarray:
        out = own.copy()
        add_at(out, second, right)
        add_at(out, first, left)
        add_at(out, graph.member, down)
        return out

    def at_keys() -> np.ndarray:
        out = np.zeros((keys, labels))
        add_at(out, graph.key, up)
        return out[graph.key]

    for _ in range(ROUNDS):
        here = beliefs()
        new = [
            normalised(log_sum((here[first] - left)[:, :, None] + weights.beside, 1)),
            normalised(log_sum((here[second] - right)[:, None, :] + weights.beside, 2)),
            normalised(log_sum((here[graph.member] - down)[:, :, None] + share, 1)),
            normalised(log_sum((at_keys() - up)[:, None, :] + share, 2)),
        ]
        moved = 0.0
        for old, now in zip((right, left, up, down), new, strict=True):
            moved = max(moved, float(np.abs(now - old).max(initial=0)))
            old += (1 - DAMPING) * (now - old)
        if moved < SETTLED:
            break
    here = beliefs()
    pairs = (here[first] - left)[:, :, None] + weights.beside + (here[second] - right)[:, None, :]
    shared = (here[graph.member] - down)[:, :, None] + share + (at_keys() - up)[:, None, :]
    return np.exp(normalised(here)), spread(pairs), spread(shared)


def spread(x: np.ndarray) -> np.ndarray:
    flat = x.reshape(len(x), x.shape[1] * x.shape[2])
    return np.exp(normalised(flat)).reshape(x.shape) if len(x) else x


def common_labels(graph: Graph, label: np.ndarray, labels: int) -> np.ndarray:
    """The label that most words of each key have (ties: the smaller), for every membership."""
    votes = np.zeros((int(graph.key.max(initial=-1)) + 1, labels))
    np.add.at(votes, (graph.key, label[graph.member]), 1)
    return votes.argmax(axis=1)[graph.key] if len(votes) else graph.key


def gradient(graph: Graph, label: np.ndarray, weights: Weights) -> np.ndarray:
    """Gradient of the log likelihood of the labels: what they show less what the model expects."""
    labels = len(weights.agree)
    node, pair, shared = infer(graph, weights)
    out = Weights(np.zeros_like(weights.flat), len(weights.features), labels)
    node = -node
    node[np.arange(len(label)), label] += 1
    for slot in graph.features.T:
        known = slot >= 0
        add_at(out.features, slot[known], node[known])
    out.beside -= pair.sum(axis=0)
    np.add.at(out.beside, (label[graph.chain[:, 0]], label[graph.chain[:, 1]]), 1)
    common = common_labels(graph, label, labels)
    own = label[graph.member]
    out.agree += np.bincount(own[own == common], minlength=labels) - np.einsum("myy->y", shared)
    return out.flat


class Resilient:
    """Steps by the signs of gradients alone."""

    def __init__(self, features: int, labels: int) -> None:
        size = Weights.size(features, labels)
        self.prior = np.full(size, PRIOR)
        self.prior[-labels:] = PRIOR_AGREE
        self.weights, self.step, self.last = np.zeros(size), np.full(size, 0.3), np.zeros(size, dtype=np.int64)

    def move(self, grad: np.ndarray) -> None:
        grad = grad - self.prior * self.weights
        sign = np.where(np.abs(grad) < 1e-6, 0, np.sign(grad)).astype(np.int64)
        turn = sign * self.last
        self.step = np.clip(np.where(turn > 0, self.step * 1.3, np.where(turn < 0, self.step * 0.5, self.step)), 1e-4, 2.0)
        sign[turn < 0] = 0
        self.weights = self.weights + sign * self.step
        self.last = sign
