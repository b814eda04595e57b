"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte of a text. It is a pair of gated recurrent layers of HIDDEN units, one per direction,
with a softmax over both, trained here in numpy by backpropagation through time on windows of a bounded sample of the
labelled rows: of every language that has a row, at most SAMPLE_DOCS documents, those with the smallest hash of their row,
and of each a piece of at most SAMPLE_CHARS characters from a place that the hash picks. That bounds the rows of a class,
never the classes. A document's probabilities are the mean over all its bytes.

Texts are read in windows of WINDOW bytes, so a state never depends on more than a window and long texts need no more
memory than short ones. The last window of a text overlaps the one before; overlapped bytes count once.

Defined cases: a null text and a text without a letter are `und` with score 0; so is every text if no row taught a
language; between equally likely languages the first by name is taken; rows with one doc_id twice are labelled apart;
repeated rows teach once; an empty table gives no rows; further columns are kept, but for lang_pred and lang_score, which
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, free_memory, joined, release

WINDOW, HIDDEN, BATCH = 64, 8, 4096
SAMPLE_DOCS, SAMPLE_CHARS = 200, 4_000
#: Bytes of text that are labelled together.
POOL_BYTES = 1 << 20
STEPS, TRAIN_BATCH, RATE, SEED = 500, 96, 0.02, 42
UNDETERMINED = "und"
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


@dataclass
class Network:
    """Per direction: x (3H, 256) input weights with biases, u (3H, H) recurrent weights, o (C, H) output weights."""

    languages: list[str]
    x: list[np.ndarray]
    u: list[np.ndarray]
    o: list[np.ndarray]
    bias: np.ndarray


def _sigmoid(a: np.ndarray) -> np.ndarray:
    a *= 0.5
    np.tanh(a, out=a)
    a += 1
    a *= 0.5
    return a


def run(net: Network, windows: np.ndarray) -> np.ndarray:
    """Probabilities (T, C, B) of every byte of windows (T, B)."""
    steps, n = windows.shape
    out = np.empty((steps, len(net.bias), n), np.float32)
    out[:] = net.bias[:, None]
    hidden = net.u[0].shape[1]
    got, gate, part = np.empty((3 * hidden, n), np.float32), np.empty((3 * hidden, n), np.float32), np.empty((hidden, n), np.float32)
    for way in (0, 1):
        x, u, o = net.x[way], net.u[way], net.o[way]
        state = np.zeros((hidden, n), np.float32)
        for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
            np.take(x, windows[t], axis=1, out=got, mode="clip")
            np.matmul(u, state, out=gate)
            zr = got[: 2 * hidden]
            zr += gate[: 2 * hidden]
            _sigmoid(zr)
            z, r = zr[:hidden], zr[hidden:]
            np.multiply(r, gate[2 * hidden :], out=part)
            part += got[2 * hidden :]
            np.tanh(part, out=part)
            state -= part
            state *= z
            state += part
            out[t] += o @ state
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(document, language): mean probability over all bytes of each text."""
    windows, owner, counted = [], [], []
    for k, text in enumerate(texts):
        n = len(text)
        raw = np.frombuffer(text if n >= WINDOW else text.ljust(WINDOW), np.uint8)
        whole = len(raw) // WINDOW
        windows.append(raw[: whole * WINDOW].reshape(whole, WINDOW))
        counted.append(np.full((whole, 2), (0, min(n, WINDOW)), np.int16))
        if len(raw) % WINDOW:
            windows.append(raw[-WINDOW:].reshape(1, WINDOW))
            counted.append(np.array([(WINDOW - len(raw) % WINDOW, WINDOW)], np.int16))
            whole += 1
        owner.append(np.full(whole, k, np.int32))
    total = np.zeros((len(texts), len(net.bias)))
    if not windows:
        return total
    rows, owner, counted = np.concatenate(windows), np.concatenate(owner), np.concatenate(counted)
    for at in range(0, len(rows), BATCH):
        some, place = rows[at : at + BATCH].T, np.arange(WINDOW)[:, None]
        probs = run(net, some)
        limits = counted[at : at + BATCH]
        part = (limits[:, 0] > 0) | (limits[:, 1] < WINDOW)
        if part.any():
            probs[:, :, part] *= ((place >= limits[part, 0]) & (place < limits[part, 1]))[:, None, :]
        np.add.at(total, owner[at : at + BATCH], probs.sum(axis=0).T)
    return total / np.maximum(1, [len(t) for t in texts])[:, None]


def train(samples: dict[str, list[bytes]]) -> Network:
    """Fit a network on texts by language, by backpropagation through time with Adam steps."""
    rng, languages = np.random.default_rng(SEED), sorted(samples)
    H, C, B = HIDDEN, len(languages), TRAIN_BATCH
    p = {}
    for d in (0, 1):
        p[f"x{d}"] = rng.normal(0, 0.3, (3 * H, 256))
        p[f"u{d}"] = rng.normal(0, 0.5 / np.sqrt(H), (3 * H, H))
        p[f"o{d}"] = rng.normal(0, 0.5 / np.sqrt(H), (C, H))
    p["bias"] = np.zeros(C)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    pool = {c: np.frombuffer(b" ".join(t for t in samples[c] if t).ljust(WINDOW + 1), np.uint8) for c in languages}
    for step in range(1, STEPS + 1):
        y = rng.integers(0, C, B)
        w = np.stack([pool[languages[c]][(s := rng.integers(0, len(pool[languages[c]]) - WINDOW)) : s + WINDOW] for c in y], axis=1)
        kept, logits = [], np.repeat(p["bias"][None, :, None], WINDOW, axis=0).repeat(B, axis=2)
        for d in (0, 1):
            h, steps = np.zeros((H, B)), []
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                a, g = p[f"x{d}"][:, w[t]], p[f"u{d}"] @ h
                zr = 1 / (1 + np.exp(-(a[: 2 * H] + g[: 2 * H])))
                z, r = zr[:H], zr[H:]
                n = np.tanh(a[2 * H :] + r * g[2 * H :])
                new = n + z * (h - n)
                steps.append((t, h, z, r, n, g[2 * H :], new))
                h = new
                logits[t] += p[f"o{d}"] @ h
            kept.append(steps)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        off = e / e.sum(axis=1, keepdims=True)
        off[:, y, np.arange(B)] -= 1
        off /= WINDOW * B
        grad = {k: np.zeros_like(a) for k, a in p.items()}
        grad["bias"] = off.sum(axis=(0, 2))
        for d in (0, 1):
            back = np.zeros((H, B))
            for t, h, z, r, n, gn, new in reversed(kept[d]):
                grad[f"o{d}"] += off[t] @ new.T
                back = back + p[f"o{d}"].T @ off[t]
                dn = back * (1 - z) * (1 - n * n)
                dz = back * (h - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                da = np.concatenate([dz, dr, dn])
                dg = np.concatenate([dz, dr, dn * r])
                np.add.at(grad[f"x{d}"].T, w[t], da.T)
                grad[f"u{d}"] += dg @ h.T
                back = back * z + p[f"u{d}"].T @ dg
        rate = RATE * (1 - step / (STEPS + 1))
        for k, g in grad.items():
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g * g
            p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    f = lambda k: [np.ascontiguousarray(p[f"{k}{d}"], np.float32) for d in (0, 1)]
    return Network(languages, f("x"), f("u"), f("o"), p["bias"].astype(np.float32))


def piece(text, size: int):
    """At most `size` characters of a text column, from a place that the text's hash picks."""
    room = F.greatest(F.char_length(text) - size, F.lit(0))
    return F.substring(text, F.pmod(F.xxhash64(text), room + 1).cast("int") + 1, F.lit(size))


def sample(docs: DataFrame) -> DataFrame:
    """lang, doc_id, text: the bounded sample that a network is fitted on. Each task passes on SAMPLE_DOCS rows of a language
    at most, and only their keys; their texts come in a second pass."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang IS NOT NULL AND text <> ''")
    keyed = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = cut(keyed.select("lang", "key").distinct().withColumn("rank", rank).where(F.col("rank") <= SAMPLE_DOCS).drop("rank"), "language-sample")
    found = cut(joined(keyed, chosen, ["lang", "key"], "left_semi").select("lang", "doc_id", piece(F.col("text"), SAMPLE_CHARS).alias("text")).distinct(), "language-texts")
    release(chosen)
    return found


def fit(docs: DataFrame) -> Network | None:
    """Fit on a bounded sample of the rows of docs (doc_id, text, lang) that have a language; None if there is none."""
    found = sample(docs)
    texts = found.toPandas().sort_values(["lang", "doc_id", "text"])  # SAMPLE_DOCS pieces of SAMPLE_CHARS characters for a language
    release(found)
    net = train({c: [t.encode("utf-8", "replace") for t in g["text"]] for c, g in texts.groupby("lang")}) if len(texts) else None
    free_memory()
    return net


def portions_of(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of POOL_BYTES bytes or little more, so that memory does not grow with a batch."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= POOL_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """The columns of docs, and lang_pred and lang_score."""
    if net is None:
        return docs.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("lang_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some thousand numbers

    def labelled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        names = np.array(own.languages, object)
        for texts in batches:
            parts = [pooled(own, part) for part in portions_of((t or "").encode("utf-8", "replace") for t in texts)]
            probs = np.concatenate(parts) if parts else np.zeros((0, len(names)))
            yield pd.DataFrame({"lang_pred": names[probs.argmax(axis=1)] if len(probs) else [], "score": np.clip(probs.max(axis=1, initial=0), 0, 1)})
        free_memory()

    labelled.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    text = F.col("text").cast("string")
    readable = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = docs.withColumn("__language", F.pandas_udf(labelled, RESULT)(text))
    found = found.withColumn("lang_pred", F.when(readable, F.col("__language.lang_pred")).otherwise(UNDETERMINED))
    return found.withColumn("lang_score", F.when(readable, F.col("__language.score")).otherwise(0.0)).drop("__language")
