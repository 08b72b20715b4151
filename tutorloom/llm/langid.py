"""Language identification by a bidirectional gated recurrent network over bytes.

A text's bytes are read in windows of ``WINDOW`` bytes, each from both sides. A cell of ``HIDDEN`` units has an update and a reset
gate; gates and candidate are piecewise linear (clipped), so reading costs a table look-up, a small product and a few
sums per byte. Both directions together give every byte a probability for each language; a document's probabilities are the means over
all its bytes. The network is trained in numpy by backpropagation through time, with a label at every position.

It learns from a bounded sample: of each language the ``DOCUMENTS`` training documents with the smallest hash of their id, and
``PLACES`` windows at hashed places of each. Predictions read whole texts, and nothing but the text.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if there is nothing to learn from; equal
probabilities go to the language that sorts first; repeated rows are predicted each; columns named like an output column are
replaced, all others kept. More than ``MOST_LANGUAGES`` labels are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tutorloom.llm.common import slices

WINDOW, HIDDEN, PAD = 64, 12, 256
DOCUMENTS, PLACES, MOST_LANGUAGES = 500, 3, 100
ROUNDS, BATCH, RATE = 7, 256, 0.02
LANES = 2048  # windows that are read side by side
SLICE_CHARS = 2_000_000
UNKNOWN = "und"


@dataclass
class Network:
    """Per direction: what a byte adds to gates and candidate (``inputs``), and what the state adds (``carried``)."""

    languages: list[str]
    inputs: list[np.ndarray]
    carried: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.carried, self.out, self.bias]


def _start(languages: list[str], rng: np.random.Generator) -> Network:
    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    inputs = [draw(PAD + 1, 3 * HIDDEN, scale=0.3) for _ in range(2)]
    for x in inputs:
        x[:, : 2 * HIDDEN] += 0.5  # gates start half open
    return Network(languages, inputs, [draw(HIDDEN, 3 * HIDDEN, scale=0.2) for _ in range(2)], draw(2 * HIDDEN, len(languages), scale=0.2), np.zeros(len(languages), np.float32))


def _read(inputs: np.ndarray, carried: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """States (step, lane, unit) after each step over ``codes`` (step, lane)."""
    n = HIDDEN
    states = np.empty((*codes.shape, n), np.float32)
    state = np.zeros((codes.shape[1], n), np.float32)
    for t, code in enumerate(codes):
        x = inputs[code]
        g = state @ carried
        gates = np.minimum(np.maximum(x[:, : 2 * n] + g[:, : 2 * n], 0), 1)  # update, reset
        new = g[:, 2 * n :] * gates[:, n:]
        new += x[:, 2 * n :]
        np.maximum(new, -1, out=new)
        np.minimum(new, 1, out=new)
        state = state - new
        state *= gates[:, :n]
        state += new
        states[t] = state
    return states


def _learn_from(inputs: np.ndarray, carried: np.ndarray, codes: np.ndarray, states: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``inputs`` and ``carried``, given the loss's gradient ``above`` of every state: back through time."""
    n = HIDDEN
    d_inputs, d_carried = np.zeros_like(inputs), np.zeros_like(carried)
    flowing = np.zeros_like(above[0])
    for t in range(len(codes) - 1, -1, -1):
        before = states[t - 1] if t else np.zeros_like(states[0])
        x, g = inputs[codes[t]], before @ carried
        raw = x[:, : 2 * n] + g[:, : 2 * n]
        gates = np.clip(raw, 0, 1)
        update, reset = gates[:, :n], gates[:, n:]
        raw_new = x[:, 2 * n :] + reset * g[:, 2 * n :]
        new = np.clip(raw_new, -1, 1)
        d = above[t] + flowing
        d_new = d * (1 - update) * (raw_new == new)
        d_gates = np.concatenate([d * (before - new), d_new * g[:, 2 * n :]], axis=1) * (raw == gates)
        d_x = np.concatenate([d_gates, d_new], axis=1)
        d_g = np.concatenate([d_gates, d_new * reset], axis=1)
        np.add.at(d_inputs, codes[t], d_x)
        d_carried += before.T @ d_g
        flowing = d * update + d_g @ carried.T
    return d_inputs, d_carried


def _probabilities(net: Network, codes: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(step, lane, language) for windows ``codes`` (step, lane), and the states of both directions in page order."""
    ahead = _read(net.inputs[0], net.carried[0], codes)
    back = _read(net.inputs[1], net.carried[1], codes[::-1])[::-1]
    p = np.exp(np.clip(ahead @ net.out[:HIDDEN] + back @ net.out[HIDDEN:] + net.bias, -30, 30))
    return p / p.sum(axis=2, keepdims=True), [ahead, back]


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes (window, step) of all texts, padded to whole windows, and the number of windows of each."""
    counts = np.array([-(-len(x) // WINDOW) for x in texts], np.int64)
    codes = np.full(int(counts.sum()) * WINDOW, PAD, np.int16)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        codes[at : at + len(text)] = np.frombuffer(text, np.uint8)
        at += n * WINDOW
    return codes.reshape(-1, WINDOW), counts


def train(samples: list[tuple[bytes, str]], seed: int = 7) -> Network:
    """A network that labels the bytes of ``samples``: pieces of text of at most ``WINDOW`` bytes with their language."""
    languages = sorted({lang for _, lang in samples})
    rng = np.random.default_rng(seed)
    net = _start(languages, rng)
    codes, _ = windows_of([s[:WINDOW] for s, _ in samples])
    labels = np.array([languages.index(lang) for _, lang in samples])
    # languages count alike, however many samples they have
    worth = (len(samples) / len(languages) / np.bincount(labels))[labels].astype(np.float32)
    first, second = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()]
    step = 0
    steps = ROUNDS * -(-len(samples) // BATCH)
    for _ in range(ROUNDS):
        order = rng.permutation(len(samples))
        for low in range(0, len(order), BATCH):
            pick = order[low : low + BATCH]
            own = np.ascontiguousarray(codes[pick].T)
            p, (ahead, back) = _probabilities(net, own)
            weight = (own != PAD) * worth[pick]
            d = p.copy()
            np.put_along_axis(d, np.broadcast_to(labels[pick][None, :, None], (*own.shape, 1)), np.take_along_axis(p, np.broadcast_to(labels[pick][None, :, None], (*own.shape, 1)), 2) - 1, 2)
            d *= (weight / max(weight.sum(), 1))[:, :, None].astype(np.float32)
            flat = d.reshape(-1, len(languages))
            d_out = np.concatenate([ahead.reshape(-1, HIDDEN).T @ flat, back.reshape(-1, HIDDEN).T @ flat])
            a_in, a_carried = _learn_from(net.inputs[0], net.carried[0], own, ahead, d @ net.out[:HIDDEN].T)
            b_in, b_carried = _learn_from(net.inputs[1], net.carried[1], own[::-1], back[::-1], (d @ net.out[HIDDEN:].T)[::-1])
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for value, grad, m, v in zip(net.parameters(), [a_in, b_in, a_carried, b_carried, d_out, flat.sum(axis=0)], first, second, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= (rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label(net: Network, texts: list[bytes]) -> np.ndarray:
    """(text, language): mean probabilities over all bytes of each text (no byte: zeros)."""
    codes, counts = windows_of(texts)
    sums = np.zeros((len(codes), len(net.languages)), np.float64)
    for low in range(0, len(codes), LANES):
        own = np.ascontiguousarray(codes[low : low + LANES].T)
        p, _ = _probabilities(net, own)
        sums[low : low + LANES] = np.einsum("tbc,tb->bc", p, (own != PAD).astype(np.float32))
    total = np.concatenate([np.zeros((1, len(net.languages))), np.cumsum(sums, axis=0)])
    ends = np.cumsum(counts)
    return (total[ends] - total[ends - counts]) / np.maximum([len(x) for x in texts], 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, doc_id: str, text: str, lang: str) -> list[tuple[bytes, str]]:
    """At most ``DOCUMENTS`` * ``PLACES`` pieces of at most ``WINDOW`` characters for each language."""
    known = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    known = known.where(F.col("text").rlike(r"\p{L}"))
    if (n := known.select("lang").distinct().limit(MOST_LANGUAGES + 1).count()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages ({n})")
    size = F.char_length("text")
    places = F.array(*(F.pmod(F.xxhash64("id", F.lit(k)), F.greatest(size - WINDOW, F.lit(1))).cast("int") for k in range(PLACES)))
    pieces = F.transform(F.array_distinct(places), lambda at: F.substring("text", at + 1, F.lit(WINDOW)))
    ranked = known.select("lang", F.xxhash64("id").alias("order"), pieces.alias("pieces"))
    chosen = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "pieces"))).where(F.col("rank") <= DOCUMENTS)
    return sorted((piece.encode()[:WINDOW], row.lang) for row in chosen.select("lang", "pieces").toLocalIterator() for piece in row.pieces if piece)


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE_CHARS):
            texts = [t if net and t and any(map(str.isalpha, t)) else "" for t in part.column(text).to_pylist()]
            languages, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if any(texts):
                p = label(net, [t.encode() for t in texts])
                best = p.argmax(axis=1)
                languages = [net.languages[i] if t else UNKNOWN for i, t in zip(best.tolist(), texts, strict=True)]
                scores = np.clip(p[np.arange(len(texts)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def predict_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, learned from those of its documents that aren't held out."""
    sample = training_sample(docs, doc_id, text, lang)
    return identify(docs, train(sample) if sample else None, text)
