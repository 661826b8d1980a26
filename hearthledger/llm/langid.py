"""Language identification (operator 7): a bidirectional gated recurrent network over bytes.

Two GRUs of HIDDEN units read windows of WINDOW bytes, one from each end; at every position a softmax over
both states gives language probabilities, and a document's probability of a language is the mean over all
its positions. The network is trained here, in numpy, by backpropagation through time with Adam, on
positions of windows drawn from at most ``max_train`` labelled documents. A whole text is read, window after
window; windows of many documents advance together, so that every step is a few small matrix products.

Training documents: ``crc32(doc_id as text) % 5 <> 0`` and a language; of these a hashed share whose expected
number is below ``max_train`` (a documented bound, the only sample here); texts shorter than a training
window are repeated until they fill it. Inputs of a prediction are the
bytes of the text, nothing else.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any labelled document
everything is ``und``; a null doc_id counts as not held out; ties go to the language first in code point
order; repeated rows are predicted each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8

HIDDEN = 8
WINDOW = 128
TRAIN_WINDOW = 64
WINDOWS_PER_DOC = 6
MAX_TRAIN = 3_000
STEPS = 350
BATCH = 192
#: Windows that advance together when predicting.
LANES = 2048
FOLDS = 5
UNKNOWN = "und"
#: A letter is a character of the Unicode categories L.
_LETTER = regex.compile(r"\p{L}")


def held_out(folds: int = FOLDS, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def hashed_sample(rows: DataFrame, bound: int) -> DataFrame:
    """Rows by the hash of doc_id, nine tenths of ``bound`` expected, ``bound`` at most."""
    n = rows.count()
    space = 1 << 32
    cut = space if n <= bound else int(0.9 * bound / n * space)
    return rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < cut).limit(bound)


def _tanh(x: np.ndarray, top: np.ndarray, low: np.ndarray) -> None:
    """tanh in place by a continued fraction, to about 1e-3; several times faster than the library's."""
    np.multiply(x, x, out=low)
    np.add(low, np.float32(105), out=top)
    top *= low
    top += np.float32(945)
    x *= top
    np.multiply(low, np.float32(15), out=top)
    top += np.float32(420)
    top *= low
    top += np.float32(945)
    x /= top
    np.clip(x, np.float32(-1), np.float32(1), out=x)


class Network:
    """Weights of both directions stacked: forward 0, backward 1. Gates r, z and the candidate lie side by side."""

    def __init__(self, languages: list[str], seed: int = 7, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        h, n = hidden, max(1, len(languages))
        self.languages, self.h = languages, h
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 3 * h)).astype(np.float32),
            "u": rng.normal(0, 0.5 / np.sqrt(h), (2, h, 3 * h)).astype(np.float32),
            "b": np.zeros((2, 1, h), np.float32),
            "o": rng.normal(0, 0.5 / np.sqrt(h), (2 * h, n)).astype(np.float32),
            "c": np.zeros(n, np.float32),
        }

    def states(self, windows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states (position, direction, lane, unit) of windows (lane, position); with ``keep``, what BPTT needs."""
        lanes, length = windows.shape
        h, x, u, b = self.h, self.p["x"], self.p["u"], self.p["b"]
        both = np.stack([windows.T, windows.T[::-1]], axis=1)  # position, direction, lane
        state = np.zeros((2, lanes, h), np.float32)
        out, kept = np.empty((length, 2, lanes, h), np.float32), []
        pick = np.arange(2)[:, None]
        for t in range(length):
            got = x[pick, both[t]]
            rec = np.matmul(state, u)
            gates = np.tanh((got[..., : 2 * h] + rec[..., : 2 * h]) * 0.5) * 0.5 + 0.5
            r, z = gates[..., :h], gates[..., h:]
            mine = rec[..., 2 * h :] + b
            n = np.tanh(got[..., 2 * h :] + r * mine)
            new = n + z * (state - n)
            if keep:
                kept.append((state, r, z, mine, n))
            out[t] = state = new
        return out, kept

    def swift(self, windows: np.ndarray, backwards: np.ndarray) -> np.ndarray:
        """The states of ``states`` over windows and their reverses as (position, direction, unit, lane), written in place with a rational tanh."""
        lanes, length = windows.shape
        h, half = self.h, np.float32(0.5)
        # the gates' arguments are halved once, in the weights: sigmoid(a) = tanh(a / 2) / 2 + 1 / 2
        scale = np.concatenate([np.full(2 * h, half), np.ones(h, np.float32)])
        x = np.ascontiguousarray((self.p["x"] * scale).transpose(0, 2, 1), np.float32)
        u = np.ascontiguousarray((self.p["u"] * scale).transpose(0, 2, 1), np.float32)
        b = np.ascontiguousarray(self.p["b"].transpose(0, 2, 1), np.float32)
        both = np.stack([windows.T, backwards.T], axis=1).astype(np.intp)
        out = np.empty((length, 2, h, lanes), np.float32)
        got, rec = np.empty((2, 3 * h, lanes), np.float32), np.empty((2, 3 * h, lanes), np.float32)
        gates, n = np.empty((2, 2 * h, lanes), np.float32), np.empty((2, h, lanes), np.float32)
        scratch = np.empty_like(gates), np.empty_like(gates), np.empty_like(n), np.empty_like(n)
        state = np.zeros((2, h, lanes), np.float32)
        for t in range(length):
            for k in range(2):
                np.take(x[k], both[t, k], axis=1, out=got[k], mode="clip")
            np.matmul(u, state, out=rec)
            np.add(got[:, : 2 * h], rec[:, : 2 * h], out=gates)
            _tanh(gates, *scratch[:2])
            gates *= half
            gates += half
            np.add(rec[:, 2 * h :], b, out=n)
            n *= gates[:, :h]
            n += got[:, 2 * h :]
            _tanh(n, *scratch[2:])
            new = out[t]
            np.subtract(state, n, out=new)
            new *= gates[:, h:]
            new += n
            state = new
        return out

    def logits(self, states: np.ndarray) -> np.ndarray:
        """(position, lane, language): forward state after the byte, backward state after it from the other end."""
        joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        return joined @ self.p["o"] + self.p["c"]

    def probabilities(self, windows: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """(position, language, lane). With ``sizes``, only the first bytes of a window count: both directions read them alone."""
        length = windows.shape[1]
        if sizes is None:
            states = self.swift(windows, windows[:, ::-1])
            other = states[::-1, 1]
        else:
            mirror = np.maximum(sizes[:, None] - 1 - np.arange(length), 0)
            states = self.swift(windows, np.take_along_axis(windows, mirror, axis=1))
            other = np.take_along_axis(states[:, 1], mirror.T[:, None, :], axis=0)
        e = np.matmul(np.ascontiguousarray(self.p["o"].T), np.concatenate([states[:, 0], other], axis=1))
        e += self.p["c"][:, None]
        e -= e.max(axis=1, keepdims=True)
        np.exp(e, out=e)
        e /= e.sum(axis=1, keepdims=True)
        return e

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions, and its gradient by backpropagation through time."""
        states, kept = self.states(windows, keep=True)
        lanes, length = windows.shape
        h = self.h
        e = self.logits(states)
        e -= e.max(axis=-1, keepdims=True)
        e = np.exp(e)
        e /= e.sum(axis=-1, keepdims=True)
        at = np.arange(lanes)
        loss = -float(np.log(e[:, at, labels] + 1e-12).mean())
        e[:, at, labels] -= 1
        e /= length * lanes
        joined = np.concatenate([states[:, 0], states[::-1, 1]], axis=-1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"] = np.einsum("tlh,tlc->hc", joined, e)
        g["c"] = e.sum(axis=(0, 1))
        back = e @ self.p["o"].T
        outer = np.stack([back[..., :h], back[::-1, :, h:]], axis=1)
        both = np.stack([windows.T, windows.T[::-1]], axis=1)
        d = np.zeros((2, lanes, h), np.float32)
        for t in range(length - 1, -1, -1):
            state, r, z, mine, n = kept[t]
            d = d + outer[t]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (state - n) * z * (1 - z)
            dr = dn * mine * r * (1 - r)
            rec = np.concatenate([dr, dz, dn * r], axis=-1)
            inp = np.concatenate([dr, dz, dn], axis=-1)
            g["u"] += np.matmul(state.transpose(0, 2, 1), rec)
            g["b"] += (dn * r).sum(axis=1, keepdims=True)
            for k in range(2):
                np.add.at(g["x"][k], both[t, k], inp[k])
            d = d * z + np.matmul(rec, self.p["u"].transpose(0, 2, 1))
        return loss, g

    def fit(self, windows: np.ndarray, labels: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        kinds = [np.flatnonzero(labels == c) for c in range(len(self.languages))]
        for step in range(1, steps + 1):
            some = np.concatenate([rng.choice(k, -(-batch // len(kinds))) for k in kinds if len(k)])  # languages in equal parts
            _, g = self.gradients(windows[some], labels[some])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            pace = rate * (1 - 0.9 * step / steps)
            for k, x in g.items():
                x = x * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (text, language) over all positions of each whole text."""
        total = np.zeros((len(texts), len(self.languages)))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        full, rest = sizes // WINDOW, sizes % WINDOW
        owner = np.repeat(np.arange(len(texts)), full)
        first = np.concatenate([[0], np.cumsum(full)])
        at = begin[owner] + (np.arange(len(owner)) - first[owner]) * WINDOW
        for i in range(0, len(owner), LANES):
            got = self.probabilities(raw[at[i : i + LANES, None] + np.arange(WINDOW)])
            np.add.at(total, owner[i : i + LANES], got.sum(axis=0).T)
        # what is left over, the shorter windows sorted by length: each group reads its own number of bytes
        tails = np.flatnonzero(rest)
        tails = tails[np.argsort(rest[tails], kind="stable")]
        for i in range(0, len(tails), 512):
            some = tails[i : i + 512]
            length = int(rest[some].max())
            where = begin[some] + full[some] * WINDOW
            inside = np.arange(length) < rest[some, None]
            cells = np.where(inside, raw[np.minimum(where[:, None] + np.arange(length), len(raw) - 1)], 0)
            got = self.probabilities(cells, rest[some])
            total[some] += (got * inside.T[:, None, :]).sum(axis=0).T
        return total / np.maximum(1, sizes)[:, None]


def training_windows(docs: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows (window, byte), their language numbers, and the languages; from the bounded sample."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0)).filter(~held_out())
    languages = sorted(r[0] for r in labelled.select("lang").distinct().collect())
    number = {x: i for i, x in enumerate(languages)}
    span = 2 * TRAIN_WINDOW
    starts = [F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(k)), F.greatest(F.length("text") - span, F.lit(1))) + 1).cast("int"), F.lit(span)) for k in range(WINDOWS_PER_DOC)]
    windows, labels = [], []
    for r in hashed_sample(labelled.select("doc_id", "text", "lang"), max_train).select("lang", F.array(*starts).alias("w")).collect():
        for w in map(str.encode, r.w):
            windows.append((w * -(-TRAIN_WINDOW // len(w)))[:TRAIN_WINDOW])  # a shorter text is repeated until it fills the window
            labels.append(number[r.lang])
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, TRAIN_WINDOW), np.asarray(labels, np.int64), languages


def train(docs: DataFrame, max_train: int = MAX_TRAIN) -> Network:
    windows, labels, languages = training_windows(docs, max_train)
    net = Network(languages)
    return net.fit(windows, labels) if len(labels) else net


def identify(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                texts = list(utf8(part.column(2)))
                known = [bool(net.languages) and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts]
                got = net.predict([t for t, k in zip(texts, known, strict=True) if k]) if any(known) else np.zeros((0, 1))
                best, top = iter(got.argmax(axis=1).tolist()), iter(got.max(axis=1).tolist())
                names = [net.languages[next(best)] if k else UNKNOWN for k in known]
                scores = [min(1.0, next(top)) if k else 0.0 for k in known]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, train(docs))
