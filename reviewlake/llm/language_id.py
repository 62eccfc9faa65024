"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into chunks of a fixed number of bytes; within a chunk each position sees all bytes before it in one direction
and all behind it in the other. Every position gets a probability for each language, and a document the mean over all its
positions. Trained in numpy by backpropagation through time on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm.common import hash_sample, load, pick, utf8
from reviewlake.llm.quality_model import held_out
from reviewlake.llm.registry import query

CHUNK = 128
HIDDEN = 8
#: The training sample: at most so many rows of each language, each with so many chunks from hashed places.
ROWS_PER_LANGUAGE = 400
CHUNKS_PER_ROW = 2
STEPS = 360
BATCH = 96
UNKNOWN = "und"
_PAD = 256
_BLOCK = 1024


def _sigmoid(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    out = np.negative(x, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


@dataclass
class Gru:
    """One direction. Columns of ``inputs`` (a row for each byte) and ``recurrent``: update gate, reset gate, candidate."""

    inputs: np.ndarray
    recurrent: np.ndarray

    def states(self, steps: np.ndarray) -> np.ndarray:
        """Hidden states (time, unit, row) for symbols (time, row). Units come first, so that every operation runs over whole rows."""
        n, h = steps.shape[1], len(self.recurrent)
        inputs, recurrent = np.ascontiguousarray(self.inputs.T), np.ascontiguousarray(self.recurrent.T)
        out = np.empty((len(steps), h, n), np.float32)
        state, hu, x = np.zeros((h, n), np.float32), np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        gates, cand = np.empty((2 * h, n), np.float32), np.empty((h, n), np.float32)
        for t, symbols in enumerate(steps):
            np.take(inputs, symbols, axis=1, out=x, mode="clip")
            np.matmul(recurrent, state, out=hu)
            np.add(x[:2 * h], hu[:2 * h], out=gates)
            _sigmoid(gates, gates)
            np.multiply(gates[h:], hu[2 * h:], out=cand)
            cand += x[2 * h:]
            np.tanh(cand, out=cand)
            new = out[t]
            np.subtract(state, cand, out=new)
            new *= gates[:h]
            new += cand
            state = new
        return out

    def backward(self, steps: np.ndarray, states: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of ``inputs`` and ``recurrent``, given the gradient ``above`` of every state."""
        h = len(self.recurrent)
        d_inputs, d_recurrent = np.zeros_like(self.inputs), np.zeros_like(self.recurrent)
        carried = np.zeros_like(states[0])
        for t in range(len(steps) - 1, -1, -1):
            state = states[t - 1] if t else np.zeros_like(states[0])
            x, hu = self.inputs[steps[t]], state @ self.recurrent
            gates = _sigmoid(x[:, :2 * h] + hu[:, :2 * h])
            update, reset = gates[:, :h], gates[:, h:]
            cand = np.tanh(x[:, 2 * h:] + reset * hu[:, 2 * h:])
            d = above[t] + carried
            d_cand = d * (1 - update) * (1 - cand ** 2)
            d_update = d * (state - cand) * update * (1 - update)
            d_reset = d_cand * hu[:, 2 * h:] * reset * (1 - reset)
            d_x = np.concatenate([d_update, d_reset, d_cand], axis=1)
            d_hu = np.concatenate([d_update, d_reset, d_cand * reset], axis=1)
            np.add.at(d_inputs, steps[t], d_x)
            d_recurrent += state.T @ d_hu
            carried = d * update + d_hu @ self.recurrent.T
        return d_inputs, d_recurrent


class LanguageModel:
    """Both directions and the output layer."""

    def __init__(self, languages: list[str], arrays: list[np.ndarray]):
        self.languages, self.arrays = languages, arrays
        self.ahead, self.back = Gru(*arrays[0:2]), Gru(*arrays[2:4])
        self.output, self.bias = arrays[4], arrays[5]

    @classmethod
    def start(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 5) -> LanguageModel:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return cls(languages, [draw(257, 3 * hidden), draw(hidden, 3 * hidden), draw(257, 3 * hidden), draw(hidden, 3 * hidden),
                               draw(2 * hidden, len(languages)), np.zeros(len(languages), np.float32)])

    def positions(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities (time, language, row) of every position, and the states of both directions."""
        steps = np.ascontiguousarray(chunks.T).astype(np.intp)
        ahead, back = self.ahead.states(steps), self.back.states(steps[::-1])[::-1]
        h = ahead.shape[1]
        # States lie between -1 and 1, so the sums stay small enough for exp().
        z = np.matmul(self.output[:h].T, ahead)
        z += np.matmul(self.output[h:].T, back)
        z += self.bias[:, None]
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z, ahead, back

    def gradients(self, chunks: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy over all positions that hold a byte."""
        p, ahead, back = (x.transpose(0, 2, 1) for x in self.positions(chunks))
        steps = np.ascontiguousarray(chunks.T)
        valid = (steps != _PAD)[:, :, None]
        d = p.copy()
        d[:, np.arange(len(labels)), labels] -= 1
        d *= valid / max(1, valid.sum())
        h = ahead.shape[2]
        both = np.concatenate([ahead, back], axis=2)
        d_out = np.einsum("tbh,tbk->hk", both, d)
        d_states = d @ self.output.T
        first = self.ahead.backward(steps, ahead, d_states[:, :, :h])
        second = self.back.backward(steps[::-1], back[::-1], d_states[::-1, :, h:])
        return [*first, *second, d_out, d.sum(axis=(0, 1))]

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text, a row each; texts of any length, in blocks of bounded size."""
        total = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([max(1, len(t)) for t in texts])
        block, owners = np.full((_BLOCK, CHUNK), _PAD, np.int16), []

        def flush():
            n = len(owners)
            if n:
                p, _, _ = self.positions(block[:n])
                ends = np.flatnonzero(block[:n, -1] == _PAD)
                p[:, :, ends] *= (block[ends].T != _PAD)[:, None, :]
                np.add.at(total, owners, p.sum(axis=0, dtype=np.float64).T)
                owners.clear()
                block[:] = _PAD

        for i, text in enumerate(texts):
            raw = np.frombuffer(text, np.uint8)
            for at in range(0, len(raw), CHUNK):
                part = raw[at:at + CHUNK]
                block[len(owners), :len(part)] = part
                owners.append(i)
                if len(owners) == _BLOCK:
                    flush()
        flush()
        return total / sizes[:, None]


def train(chunks: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, rate: float = 0.03, seed: int = 3) -> LanguageModel:
    """Adam on batches with all languages equally likely; the rate falls to zero."""
    model, rng = LanguageModel.start(languages), np.random.default_rng(seed)
    by_language = [np.flatnonzero(labels == k) for k in range(len(languages))]
    mean, square = [np.zeros_like(a) for a in model.arrays], [np.zeros_like(a) for a in model.arrays]
    for step in range(1, steps + 1):
        rows = np.array([rng.choice(by_language[k]) for k in rng.integers(0, len(languages), BATCH)])
        lr = rate * (1 - (step - 1) / steps)
        for a, g, m, v in zip(model.arrays, model.gradients(chunks[rows], labels[rows]), mean, square):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= lr * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return model


def sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, parts: int = CHUNKS_PER_ROW) -> DataFrame:
    """(lang, part): pieces of at most ``rows`` rows of each language by the order of a hash of the id, none held out."""
    plain = pick(docs, doc_id="long", text="string", lang="string").where("doc_id is not null and lang is not null and text is not null")
    ids = hash_sample(plain.where(~held_out(F.col("doc_id"))), "lang", rows).dropDuplicates(["doc_id"])
    found = plain.join(F.broadcast(ids), "doc_id").where("lang = label")
    room = F.greatest(F.lit(1), F.char_length("text") - CHUNK + 1)
    places = F.explode(F.array(*(F.pmod(F.xxhash64("doc_id", F.lit(k)), room) + 1 for k in range(parts)))).alias("at")
    return found.select("doc_id", "text", "lang", places).select("doc_id", "at", "lang", F.col("text").substr(F.col("at").cast("int"), F.lit(CHUNK)).alias("part"))


def fit(docs: DataFrame) -> LanguageModel | None:
    """A model from at most ROWS_PER_LANGUAGE rows of each language; None without any labelled row."""
    rows = [(lang, utf8(part)[:CHUNK]) for _, _, lang, part in sorted(map(tuple, sample(docs).collect())) if part]
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    chunks = np.full((len(rows), CHUNK), _PAD, np.int16)
    for i, (_, part) in enumerate(rows):
        chunks[i, :len(part)] = np.frombuffer(part, np.uint8)
    labels = np.array([languages.index(lang) for lang, _ in rows])
    return train(chunks, labels, languages) if len(languages) > 1 else LanguageModel.start(languages)


def identify(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is ``und`` with score 0, as is every text if no row is labelled. Rows that repeat
    an id each give a row. The language column is read for training only.
    Very long texts are worked whole, an empty table gives no rows, and other columns, whatever their names, are not read.
    """
    model = fit(docs)
    plain = pick(docs, doc_id="long", text="string").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    parts = docs.sparkSession.sparkContext.broadcast((model.languages, model.arrays) if model else None)

    def run(source):
        own = LanguageModel(*parts.value) if parts.value else None
        for batch in source:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            known = [i for i, t in enumerate(texts) if own and any(map(str.isalpha, t))]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known:
                p = own.probabilities([utf8(texts[i]) for i in known])
                for i, k, s in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    names[i], scores[i] = own.languages[k], min(1.0, s)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(names), pa.array(scores, pa.float64())],
                                             ["doc_id", "held_out", "lang_pred", "score"])

    return plain.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))
