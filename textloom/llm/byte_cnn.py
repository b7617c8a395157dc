"""Language identification by a byte convolutional network.

The network reads windows of WINDOW bytes: filters of several widths over one-hot bytes, the maximum of each filter
over the window, and a softmax over the languages.  It is trained in numpy on the driver, on at most PER_LANG
documents of each language and SPOTS windows of each: documents that have a language and whose crc32(doc_id as
text) mod 4 is not 2.  A document is kept for the sample by its hash, with a chance that its language's
count sets, so the sample has no order and no window function.  Only text and lang are learnt from; only text is
read for a prediction.

To predict, the whole text is cut into consecutive windows, filled up with zero bytes; a document's probabilities are
the means over its windows, weighted by their bytes.  A filter over bytes is a sum of table rows, so pairs of bytes are
looked up in tables that are made from the trained filters.

Null texts, and texts without a letter, are `und` with score 0, and so is everything when there is nothing to learn from.
Rows come back one for one, with repeated and null ids as they are (a null doc_id counts as held out); other columns are
ignored.  All languages are learnt: the network has an output for each.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bytehash
from textloom.llm.common import arrow_map, read

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 8
PER_LANG, SPOTS = 1500, 3
EPOCHS, BATCH, RATE, SEED = 8, 256, 0.01, 11
#: A document whose best mean probability is below this is rejected by the pipeline.
MIN_SCORE = 0.3
_REACH = max(WIDTHS)


class ByteCnn:
    """filters[w]: w x 256 x FILTERS; bias, and the layer from the maxima to the languages."""

    def __init__(self, langs: list[str]):
        rng = np.random.default_rng(SEED)
        self.langs = langs
        n = FILTERS * len(WIDTHS)
        self.p = {f"f{w}": rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.p |= {"bias": np.zeros(n, np.float32), "out": rng.normal(0, 0.3, (n, len(langs))).astype(np.float32), "out_bias": np.zeros(len(langs), np.float32)}

    def _pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima and where they are, for windows x with _REACH - 1 zero bytes behind them."""
        tops, where = [], []
        for w in WIDTHS:
            f = self.p[f"f{w}"]
            y = f[0][x[:, :WINDOW]]
            for k in range(1, w):
                y = y + f[k][x[:, k : k + WINDOW]]
            at = y.argmax(1)
            tops.append(np.take_along_axis(y, at[:, None], 1)[:, 0])
            where.append(at)
        return np.concatenate(tops, 1) + self.p["bias"], np.concatenate(where, 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> "ByteCnn":
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        weight = 1 / np.maximum(np.bincount(y, minlength=len(self.langs)), 1)
        weight = (weight[y] / weight[y].mean()).astype(np.float32)
        step, steps = 0, EPOCHS * -(-len(x) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                rows = order[a : a + BATCH]
                xb, yb = x[rows], y[rows]
                top, at = self._pool(xb)
                h = np.maximum(top, 0)
                z = h @ self.p["out"] + self.p["out_bias"]
                z = np.exp(z - z.max(1, keepdims=True))
                d = z / z.sum(1, keepdims=True)
                d[np.arange(len(rows)), yb] -= 1
                d *= weight[rows][:, None] / len(rows)
                g = {"out": h.T @ d, "out_bias": d.sum(0)}
                d = (d @ self.p["out"].T) * (top > 0)
                g["bias"] = d.sum(0)
                for i, w in enumerate(WIDTHS):
                    part, place = d[:, FILTERS * i : FILTERS * (i + 1)], at[:, FILTERS * i : FILTERS * (i + 1)]
                    gw = np.zeros_like(self.p[f"f{w}"])
                    lane = np.broadcast_to(np.arange(FILTERS), place.shape)
                    for k in range(w):
                        np.add.at(gw[k], (np.take_along_axis(xb, place + k, 1), lane), part)
                    g[f"f{w}"] = gw
                step += 1
                rate = RATE * (1 - step / (steps + 1))
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of bytes for the starts of all filters, pairs for the ends of the widest, bytes for the ends of the middle one."""
        f2, f3, f4 = (self.p[f"f{w}"] for w in WIDTHS)
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        first = np.concatenate([pair(f2[0], f2[1]), pair(f3[0], f3[1]), pair(f4[0], f4[1])], 1)
        return np.ascontiguousarray(first), pair(f4[2], f4[3]), f3[2]


def _windows(texts: list[bytes]) -> np.ndarray:
    x = np.zeros((len(texts), WINDOW + _REACH - 1), np.uint8)
    for k, t in enumerate(texts):
        t = t[:WINDOW]
        x[k, : len(t)] = np.frombuffer(t, np.uint8)
    return x


def train(docs: DataFrame) -> ByteCnn | None:
    """A network for the languages of docs (doc_id, text, lang), or None if no document has a language."""
    learn = docs.where("lang is not null and text is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2").select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # the classes of the network
    if not counts:
        return None
    langs = sorted(counts)
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    chance = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, PER_LANG / n))])
    spot = [F.expr(f"substring(text, 1 + cast(pmod(xxhash64({k}, cast(doc_id as string)), greatest(length(text) - {WINDOW - 1}, 1)) as int), {WINDOW})")
        for k in range(SPOTS)]
    sample = learn.where(F.col("lang").isin(langs) & (draw < F.try_element_at(chance, "lang"))).select(F.xxhash64("doc_id").alias("h"), "doc_id", "lang",
        F.array_distinct(F.array(*spot)).alias("spots"))
    rows = sample.limit(2 * PER_LANG * len(langs)).collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"]))
    text, lang = [], []
    for r in rows:
        for t in r["spots"]:
            if any(c.isalpha() for c in t):
                text.append(t.encode())
                lang.append(langs.index(r["lang"]))
    if not text:
        return None
    return ByteCnn(langs).fit(_windows(text), np.array(lang))


def _predict(net: ByteCnn | None):
    def run(batches):
        tables = net and net.tables()
        for batch in batches:
            n = batch.num_rows
            lang, score = np.full(n, -1), np.zeros(n)
            if net:
                data, offsets = bytehash.buffers(batch.column(1))
                for i, j in bytehash.pieces(offsets, 1 << 19):
                    _score(net, tables, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lang[i:j], score[i:j])
            lettered = pc.fill_null(pc.match_substring_regex(batch.column(1), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names = [net.langs[x] if ok and x >= 0 else "und" for x, ok in zip(lang.tolist(), lettered)]
            score = np.where(lettered & (lang >= 0), np.clip(score, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _score(net: ByteCnn, tables, data: np.ndarray, at: np.ndarray, lang: np.ndarray, score: np.ndarray) -> None:
    """Sets language and score of the texts data[at[k]:at[k + 1]]."""
    size = np.diff(at)
    wins = -(-size // WINDOW)
    first = np.concatenate([[0], np.cumsum(wins)])
    total = int(first[-1])
    if not total:
        return
    # each window with the bytes behind it that its last filters reach: those of the same text, then zeros
    doc = np.repeat(np.arange(len(size)), wins)
    start = at[doc] + WINDOW * (np.arange(total) - first[doc])
    probs = np.empty((total, len(net.langs)), np.float32)
    padded = np.concatenate([data, np.zeros(WINDOW + _REACH, np.uint8)])
    pairs, ends, thirds = tables
    n = FILTERS
    for a in range(0, total, 256):
        s, stop = start[a : a + 256], at[doc[a : a + 256] + 1]
        index = s[:, None] + np.arange(WINDOW + _REACH - 1)
        x = padded[index]
        x[index >= np.minimum(stop, s + WINDOW)[:, None]] = 0
        two = (x[:, :-1].astype(np.uint16) << 8) | x[:, 1:]
        y = pairs.take(two[:, :WINDOW], axis=0)
        y[:, :, n : 2 * n] += thirds.take(x[:, 2 : 2 + WINDOW], axis=0)
        y[:, :, 2 * n :] += ends.take(two[:, 2 : 2 + WINDOW], axis=0)
        h = np.maximum(y.max(1) + net.p["bias"], 0)
        z = h @ net.p["out"] + net.p["out_bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        probs[a : a + 256] = z / z.sum(1, keepdims=True)
    weight = np.minimum(WINDOW, at[doc + 1] - start).astype(np.float64)
    some = np.flatnonzero(wins)
    mean = np.add.reduceat(probs * weight[:, None], first[some], axis=0) / size[some][:, None]
    lang[some] = mean.argmax(1)
    score[some] = mean.max(1)


def identify(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs (doc_id, text)."""
    held = F.coalesce(F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit(True))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    kind = dict(rows.dtypes)["doc_id"]
    return arrow_map(rows, _predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def _keep(net: ByteCnn | None, names: list[str]):
    text, run = names.index("text"), _predict(net)

    def keep(batches):
        for batch in batches:
            ids = pa.nulls(batch.num_rows, pa.int64())
            (found,) = run([pa.RecordBatch.from_arrays([ids, batch.column(text), ids], ["doc_id", "text", "held_out"])])
            good = np.array([x != "und" for x in found.column(2).to_pylist()], bool) & (found.column(3).to_numpy() >= MIN_SCORE)
            yield batch.filter(pa.array(good))

    return keep


def recognised(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """The rows of docs, with all their columns, whose language is recognised with a score of MIN_SCORE at least."""
    return arrow_map(docs, _keep(net, docs.columns), docs.schema)
