"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the bytes of a word in both directions, gives every byte a distribution over the
languages from both states, and the mean over all bytes of a document is its prediction.  States start
anew at each word, so a distinct word is read once per batch and counts as often as it occurs.  The
network is trained in numpy by backpropagation through time on words of a bounded sample of labelled
documents; whole texts are labelled in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are read in pieces of at most so many bytes.
PIECE = 24
HIDDEN, EMBED = 12, 12


def pad(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte matrix (time, words) of values 1..256, 0 after the end, and lengths; words hold 1..PIECE bytes."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    out = np.zeros((int(sizes.max(initial=0)), len(words)), dtype=np.int16)
    flat = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int16) + 1
    starts = np.cumsum(sizes) - sizes
    column = np.repeat(np.arange(len(words)), sizes)
    out[np.arange(len(flat)) - starts[column], column] = flat
    return out, sizes


class Gru:
    """One direction: update gate z, reset gate r, candidate c."""

    NAMES = ("embed", "wx", "wh", "b")

    def __init__(self, rng: np.random.Generator):
        self.p = {"embed": rng.normal(0, 0.3, (257, EMBED)), "wx": rng.normal(0, EMBED ** -0.5, (EMBED, 3 * HIDDEN)),
                  "wh": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, 3 * HIDDEN)), "b": np.zeros(3 * HIDDEN)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def forward(self, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (time, words, hidden); a step of padding keeps the state before it."""
        p, h, n = self.p, np.zeros((x.shape[1], HIDDEN), np.float32), HIDDEN
        table = p["embed"] @ p["wx"] + p["b"]
        states, tape = np.empty((*x.shape, n), np.float32), []
        for t in range(len(x)):
            a, g = table[x[t]], h @ p["wh"][:, :2 * n]
            zr = 1 / (1 + np.exp(-(a[:, :2 * n] + g)))
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(a[:, 2 * n:] + (r * h) @ p["wh"][:, 2 * n:])
            live = (x[t] > 0)[:, None]
            new = np.where(live, h + z * (c - h), h)
            if keep:
                tape.append((h, z, r, c, live))
            states[t] = h = new
        return states, tape

    def states(self, x: np.ndarray) -> np.ndarray:
        """``forward`` for words of one length, without padding."""
        p, n = self.p, HIDDEN
        h, table = np.zeros((x.shape[1], n), np.float32), p["embed"] @ p["wx"] + p["b"]
        gates, candidate, out = np.ascontiguousarray(p["wh"][:, :2 * n]), np.ascontiguousarray(p["wh"][:, 2 * n:]), np.empty((*x.shape, n), np.float32)
        for t in range(len(x)):
            a = table[x[t]]
            zr = h @ gates
            zr += a[:, :2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c = (zr[:, n:] * h) @ candidate
            c += a[:, 2 * n:]
            np.tanh(c, out=c)
            c -= h
            c *= zr[:, :n]
            h = np.add(h, c, out=out[t])
        return out

    def backward(self, x: np.ndarray, tape: list, grad: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters from those of the states."""
        p, n = self.p, HIDDEN
        d = {k: np.zeros_like(v) for k, v in p.items()}
        dh = np.zeros_like(grad[0])
        for t in reversed(range(len(x))):
            h, z, r, c, live = tape[t]
            dh = dh + grad[t]
            dn = np.where(live, dh, 0)
            dz, dc = dn * (c - h) * z * (1 - z), dn * z * (1 - c * c)
            drh = dc @ p["wh"][:, 2 * n:].T
            dr = drh * h * r * (1 - r)
            da = np.concatenate([dz, dr, dc], axis=1)
            d["wh"][:, :2 * n] += h.T @ da[:, :2 * n]
            d["wh"][:, 2 * n:] += (r * h).T @ dc
            e = p["embed"][x[t]]
            d["wx"] += e.T @ da
            d["b"] += da.sum(axis=0)
            np.add.at(d["embed"], x[t], da @ p["wx"].T)
            dh = np.where(live, dn * (1 - z) + da[:, :2 * n] @ p["wh"][:, :2 * n].T + drh * r, dh)
        return d


class Network:
    """Two ``Gru`` and a softmax at every byte."""

    def __init__(self, languages: list, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.languages, self.forth, self.back = languages, Gru(rng), Gru(rng)
        self.out = {"w": rng.normal(0, 0.1, (2 * HIDDEN, len(languages))).astype(np.float32), "c": np.zeros(len(languages), np.float32)}

    def parameters(self) -> dict[str, np.ndarray]:
        return {f"f.{k}": v for k, v in self.forth.p.items()} | {f"b.{k}": v for k, v in self.back.p.items()} | {f"o.{k}": v for k, v in self.out.items()}

    def _states(self, x: np.ndarray, sizes: np.ndarray, keep: bool):
        turned = _turned(x, sizes)
        f, f_tape = self.forth.forward(x, keep)
        b, b_tape = self.back.forward(turned, keep)
        return np.concatenate([f, _turned(b, sizes)], axis=2), turned, f_tape, b_tape

    def positions(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Distribution over the languages at every byte (time, words, languages)."""
        return _softmax(self._states(x, sizes, False)[0] @ self.out["w"] + self.out["c"])

    def words(self, words: list[bytes], at_once: int = 2048) -> np.ndarray:
        """Sum over a word's bytes of their distributions, words in rows; words of one length go together."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for size in np.unique(sizes):
            same = np.flatnonzero(sizes == size)
            for at in range(0, len(same), at_once):
                part = same[at:at + at_once]
                x = np.frombuffer(b"".join([words[i] for i in part]), dtype=np.uint8).reshape(len(part), size).T.astype(np.int16) + 1
                logits = self.forth.states(x) @ self.out["w"][:HIDDEN] + self.back.states(x[::-1])[::-1] @ self.out["w"][HIDDEN:] + self.out["c"]
                out[part] = _softmax(logits).sum(axis=0)
        return out

    def loss(self, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all bytes, and its gradients."""
        states, turned, f_tape, b_tape = self._states(x, sizes, True)
        p, live = _softmax(states @ self.out["w"] + self.out["c"]), (x > 0)
        total = live.sum()
        cost = -(np.log(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[:, :, 0] + 1e-12) * live).sum() / total
        p[:, np.arange(len(y)), y] -= 1
        d = p * (live[:, :, None] / total).astype(np.float32)
        ds = d @ self.out["w"].T
        flat, k = states.reshape(-1, 2 * HIDDEN), len(self.languages)
        grads = {"o.w": flat.T @ d.reshape(-1, k), "o.c": d.sum(axis=(0, 1))}
        grads |= {f"f.{n}": v for n, v in self.forth.backward(x, f_tape, ds[:, :, :HIDDEN]).items()}
        grads |= {f"b.{n}": v for n, v in self.back.backward(turned, b_tape, _turned(ds[:, :, HIDDEN:], sizes)).items()}
        return float(cost), grads


def _softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each word's steps in reverse order, padding left in place."""
    t = np.arange(len(x))[:, None]
    at = np.where(t < sizes, sizes - 1 - t, t)
    return x[at, np.arange(x.shape[1])]


def cut_words(text: bytes) -> list[bytes]:
    """The words of a text (ASCII white space), long ones in pieces; no byte of a word is left out."""
    words = text.split()
    if words and len(max(words, key=len)) > PIECE:
        words = [w[i:i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def train(samples: list[tuple[str, bytes]], **options) -> Network | None:
    """A network for the languages of ``samples``."""
    counts: dict[str, Counter] = {}
    for language, text in samples:
        counts.setdefault(language, Counter()).update(cut_words(text))
    return train_counts(counts, **options)


def train_counts(counts: dict[str, Counter], steps: int = 500, batch: int = 384, rate: float = 0.01, seed: int = 11) -> Network | None:
    """A network for the languages of ``counts`` (of words), by Adam; batches draw languages evenly and words by count."""
    counts = {k: c for k, c in counts.items() if c}
    if not counts:
        return None
    languages = sorted(counts)
    net, rng = Network(languages, seed), np.random.default_rng(seed)
    pools = [(list(counts[k]), np.cumsum(np.fromiter(counts[k].values(), float)) / sum(counts[k].values())) for k in languages]
    p = net.parameters()
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(len(languages), size=batch)
        words = [pools[i][0][min(int(np.searchsorted(pools[i][1], u)), len(pools[i][0]) - 1)] for i, u in zip(y.tolist(), rng.random(batch).tolist())]
        x, sizes = pad(words)
        grads = net.loss(x, sizes, y)[1]
        lr = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p[k] -= lr * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)
    return net


def _sampled(docs: DataFrame, per_language: int, text_col: str, lang_col: str, key: Column) -> DataFrame:
    """``lang, key, text`` of at most ``per_language`` texts of each language, those of the smallest keys."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), key.alias("key"), F.col(text_col).alias("text"))
    ranked = rows.select("lang", "key").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("key")))
    chosen = ranked.where(F.col("rank") <= per_language).select("lang", "key")
    return rows.join(chosen, ["lang", "key"])


def labelled_sample(docs: DataFrame, per_language: int, text_col: str, lang_col: str, key: Column, max_bytes: int) -> list[tuple[str, bytes]]:
    """The sampled texts' first ``max_bytes`` bytes."""
    found = _sampled(docs, per_language, text_col, lang_col, key).groupBy("lang", "key").agg(F.min(F.substring(F.col("text").cast("binary"), 1, max_bytes)).alias("text"))
    return sorted((r["lang"], bytes(r["text"])) for r in found.collect())


def labelled_words(docs: DataFrame, per_language: int, text_col: str, lang_col: str, key: Column) -> dict[str, Counter]:
    """Word counts of each language over the sampled texts, which tasks read whole; the driver gets the counts."""
    found = _sampled(docs, per_language, text_col, lang_col, key).groupBy("lang", "key").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for language, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = Counter(cut_words(text.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(held), pa.string()), pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["lang", "word", "c"])

    words = found.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, word binary, c bigint").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    counts: dict[str, Counter] = {}
    for language, word, c in sorted((r["lang"], bytes(r["word"]), r["c"]) for r in words.collect()):
        counts.setdefault(language, Counter())[word] = c
    return counts


def predict(docs: DataFrame, net: Network | None, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", unknown: str = "und") -> DataFrame:
    """``docs`` with the predicted language and its mean probability over all bytes of words.

    A null text and one without a letter are ``unknown`` with score 0; so is everything without a network.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(shared.value, unknown)
        for batch in batches:
            best, scores = [], []
            for part in _portions(batch.column(names.index(text_col))):
                for language, score in judge(part):
                    best.append(language)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=[*names, lang_col, score_col])

    names = docs.columns
    return docs.mapInArrow(run, docs.select("*", F.lit("").alias(lang_col), F.lit(0.0).alias(score_col)).schema)


def _portions(column: pa.Array, at_once: int = 4 << 20) -> Iterator[list[str | None]]:
    """The texts of a column in lists of about ``at_once`` characters."""
    part, size = [], 0
    for value in column:
        part.append(value.as_py())
        size += len(part[-1] or "")
        if size >= at_once:
            yield part
            part, size = [], 0
    if part:
        yield part


class Judge:
    """Predicts lists of texts; remembers what the network said of at most about ``limit`` words."""

    def __init__(self, net: Network | None, unknown: str = "und", limit: int = 400_000):
        self.net, self.unknown, self.limit = net, unknown, limit
        self.known: dict[bytes, int] = {}
        self.table = np.zeros((0, len(net.languages) if net else 0), np.float32)

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        if len(self.known) > self.limit:
            self.known, self.table = {}, self.table[:0]
        known, rows = self.known, []
        for text in texts:
            if self.net is None or text is None or not any(map(str.isalpha, text)):
                rows.append(None)
                continue
            words = cut_words(text.encode())
            at = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
            rows.append((at, sum(map(len, words))))
        new = list(known)[len(self.table):]
        if new:
            self.table = np.concatenate([self.table, self.net.words(new)])
        for row in rows:
            if row is None:
                yield self.unknown, 0.0
                continue
            p = self.table[row[0]].sum(axis=0, dtype=np.float64) / row[1]
            yield self.net.languages[int(p.argmax())], min(1.0, float(p.max()))
