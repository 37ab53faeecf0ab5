"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads the bytes of a run of letters (lower-cased; longer runs in pieces of ``PIECE`` bytes) in both
directions and gives every position a distribution over the learned languages; a document's distribution is the mean
over all its positions. The state starts anew at each run, so a run's sum is computed once in a worker and
remembered: a whole text costs one look-up a run. Trained in numpy by backpropagation through time and Adam, on runs
of at most ``train_docs`` labelled documents, ``train_runs`` of each (documented bounds); class weights even out
unequal numbers of documents.

Defined results: null text and text without a letter is `und` with score 0; equal texts get equal answers; without
labelled documents all are `und`; a row of a null id is neither held out nor learnt from; of repeated ids one row is
learnt from, and each row has its prediction; an empty table gives an empty result; texts of any length are read whole;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from texmill.llm._common import map_batches, read
from texmill.llm.resampling import runs

PIECE = 24
#: ASCII but letters is a gap between runs; bytes over 0x7F belong to runs.
_LETTERS = bytes(b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def letter_runs(text: str) -> list[bytes]:
    return text.lower().encode().translate(_LETTERS).split()


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


class Network:
    """Bidirectional gated recurrent units over bytes with a softmax at every position."""

    def __init__(self, languages: list[str], hidden: int = 12, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": (rng.standard_normal((257, 3 * hidden)) * 0.3).astype(np.float32), f"u{d}": draw(hidden, 3 * hidden)}
        self.p |= {"o": draw(2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32)}

    @staticmethod
    def _gate(x):
        return 1 / (1 + np.exp(-x))

    def _walk(self, d: str, codes: np.ndarray, mask: np.ndarray, tape: list | None) -> np.ndarray:
        """States at all positions (time, batch, hidden); codes in the order of reading; state 0 before and in padding."""
        h, n = np.zeros((codes.shape[1], self.hidden), np.float32), self.hidden
        x, u = self.p[f"x{d}"], self.p[f"u{d}"]
        out = np.empty((*codes.shape, n), np.float32)
        for t in range(len(codes)):
            given, past = x[codes[t]], h @ u
            rz = self._gate(given[:, : 2 * n] + past[:, : 2 * n])
            r, z = rz[:, :n], rz[:, n:]
            c = np.tanh(given[:, 2 * n :] + r * past[:, 2 * n :])
            new = (z * h + (1 - z) * c) * mask[t][:, None]
            if tape is not None:
                tape.append((h, r, z, c, past[:, 2 * n :]))
            h = out[t] = new
        return out

    def _back(self, d: str, codes: np.ndarray, mask: np.ndarray, tape: list, grad: np.ndarray, g: dict) -> None:
        n, u = self.hidden, self.p[f"u{d}"]
        gx, gu, gh = np.zeros_like(self.p[f"x{d}"]), np.zeros_like(u), np.zeros_like(grad[0])
        for t in range(len(codes) - 1, -1, -1):
            h, r, z, c, past = tape[t]
            dh = (grad[t] + gh) * mask[t][:, None]
            dz, dc = dh * (h - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
            dr = dc * past * r * (1 - r)
            inner = np.concatenate([dr, dz, dc * r], 1)
            gu += h.T @ inner
            gh = dh * z + inner @ u.T
            flat = np.concatenate([dr, dz, dc], 1)
            one = np.zeros((257, len(flat)), np.float32)
            one[codes[t], np.arange(len(flat))] = 1
            gx += one @ flat
        g[f"x{d}"], g[f"u{d}"] = gx, gu

    @staticmethod
    def pad(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (time, batch) read forward and backward, 256 as padding, and the mask."""
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width).astype(np.int64)
        size = np.array([len(p) for p in pieces])
        mask = np.arange(width) < size[:, None]
        forth = np.where(mask, flat, 256)
        back = np.where(mask, np.take_along_axis(flat, np.maximum(size[:, None] - 1 - np.arange(width), 0), 1), 256)
        return forth.T, back.T, mask.T.astype(np.float32)

    def states(self, pieces: list[bytes], width: int, tapes=(None, None)):
        forth, back, mask = self.pad(pieces, width)
        a, b = self._walk("f", forth, mask, tapes[0]), self._walk("b", back, mask, tapes[1])
        size = mask.sum(0).astype(np.int64)
        turn = np.maximum(size - 1 - np.arange(width)[:, None], 0)  # where the backward reader met this position
        b = np.take_along_axis(b, turn[:, :, None], 0) * mask[:, :, None]
        return forth, back, mask, turn, np.concatenate([a, b], 2)

    def probabilities(self, states: np.ndarray) -> np.ndarray:
        x = states @ self.p["o"] + self.p["c"]
        x = np.exp(x - x.max(-1, keepdims=True))
        return x / x.sum(-1, keepdims=True)

    def sums(self, pieces: list[bytes], batch: int = 4096) -> np.ndarray:
        """Per piece the sum over its positions of their distributions, then the number of positions."""
        out = np.empty((len(pieces), len(self.languages) + 1), np.float32)
        order = np.argsort([len(p) for p in pieces], kind="stable")
        for i in range(0, len(order), batch):
            take = order[i : i + batch]
            some = [pieces[k] for k in take.tolist()]
            _, _, mask, _, s = self.states(some, max(1, len(some[-1])))
            out[take, :-1] = (self.probabilities(s) * mask[:, :, None]).sum(0)
            out[take, -1] = mask.sum(0)
        return out

    def train(self, pieces: list[bytes], labels: np.ndarray, weights: np.ndarray, steps: int = 700, batch: int = 384, rate: float = 0.01, seed: int = 9) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        chance = weights / weights.sum()
        drawn = rng.choice(len(pieces), steps * batch, p=chance)
        for step in range(steps):
            take = drawn[step * batch : (step + 1) * batch]
            some = [pieces[k] for k in take.tolist()]
            tapes, g = ([], []), {}
            forth, back, mask, turn, s = self.states(some, max(map(len, some)), tapes)
            d = self.probabilities(s)
            d[:, np.arange(batch), labels[take]] -= 1
            d *= mask[:, :, None] / mask.sum()
            g["o"], g["c"] = s.reshape(-1, s.shape[2]).T @ d.reshape(-1, d.shape[2]), d.sum((0, 1))
            ds = d @ self.p["o"].T
            n = self.hidden
            db = np.take_along_axis(ds[:, :, n:], turn[:, :, None], 0) * mask[:, :, None]  # in the order of backward reading
            self._back("f", forth, mask, tapes[0], ds[:, :, :n], g)
            self._back("b", back, mask, tapes[1], db, g)
            lr = rate * min(1, 4 * (1 - step / steps))
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                self.p[k] -= (lr * first[k] / (1 - 0.9 ** (step + 1)) / (np.sqrt(second[k] / (1 - 0.99 ** (step + 1))) + 1e-8)).astype(np.float32)


class Reader:
    """Distributions of whole texts, with a memory of runs."""

    def __init__(self, network: Network, size: int = 300_000):
        self.network, self.most = network, size
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((1 << 16, len(self.network.languages) + 1), np.float32)

    def learn(self, words: set[bytes]) -> None:
        new = sorted(w for w in words if w not in self.place)
        if len(new) + len(self.place) > self.most:
            self.clear()
            new = sorted(words)
        if not new:
            return
        pieces, of = [], []
        for k, w in enumerate(new):
            for i in range(0, len(w), PIECE):
                pieces.append(w[i : i + PIECE])
                of.append(k)
        sums = np.zeros((len(new), self.table.shape[1]), np.float32)
        np.add.at(sums, np.array(of), self.network.sums(pieces))
        at = len(self.place)
        while at + len(new) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at : at + len(new)] = sums
        self.place.update(zip(new, range(at, at + len(new)), strict=True))

    def read(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        each = [letter_runs(t) if t else [] for t in texts]
        self.learn(set().union(*each))
        for text, words in zip(texts, each, strict=True):
            if not words or not (text.isascii() or any(w[0] < 128 for w in words) or has_letter(text)):
                yield "und", 0.0
                continue
            total = self.table[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))].sum(0, dtype=np.float64)
            k = int(total[:-1].argmax())
            yield self.network.languages[k], float(min(1.0, total[k] / total[-1]))


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def fit(docs: DataFrame, train_docs: int = 6000, train_runs: int = 64, hidden: int = 12, steps: int = 700) -> Network | None:
    """Train on labelled documents that are not held out."""
    spark = docs.sparkSession
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    chosen = usable.select("doc_id", "lang").orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs).collect()
    wanted = spark.sparkContext.broadcast({r.doc_id for r in chosen})

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lang, found = [], [], []
            for i, y, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if i in wanted.value and (words := letter_runs(text)):
                    ids.append(i)
                    lang.append(y)
                    found.append([words[k * len(words) // min(train_runs, len(words))][:PIECE] for k in range(min(train_runs, len(words)))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(found, pa.list_(pa.binary()))], ["doc_id", "lang", "runs"])

    rows = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").transform(map_batches, draw, "doc_id long, lang string, runs array<binary>")
    rows = rows.groupBy("doc_id").agg(F.min_by(F.struct("lang", "runs"), F.struct("lang", F.xxhash64("runs"))).alias("r")).select("doc_id", "r.*").collect()  # train_docs * train_runs pieces
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.lang))
    pieces = [bytes(w) for r in rows for w in r.runs]
    labels = np.array([languages.index(r.lang) for r in rows for _ in r.runs])
    weights = 1 / np.bincount(labels, minlength=len(languages))[labels]
    network = Network(languages, hidden)
    network.train(pieces, labels, weights, steps)
    return network


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, lang_pred, score of every document, from its text alone."""
    if network is None:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    given = docs.sparkSession.sparkContext.broadcast(network)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(given.value)
        for batch in batches:
            found = [x for _, texts in runs(batch.column(1).to_pylist()) for x in reader.read(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").transform(map_batches, predict, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.round("score", 6).alias("score"))
