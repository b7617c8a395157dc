"""Document quality by co-training of two views.

One view sees the text only: shares of byte classes, word statistics and hashed word frequencies.  The other
sees metadata only: hashed source and lang, and the recorded length.  Each has a logistic classifier, first
trained on labelled documents.  In each of ROUNDS rounds each classifier labels the documents of an
unlabelled pool of which it is most confident, in the shares of the labelled classes, and hands them to the
*other* one, which is trained again.  Both views are calibrated by a logistic curve on labelled documents kept out of the
training, joined as the sum of their log-odds less the prior's, and score all documents.

The labelled documents for training are about SAMPLE, drawn by the hash of their doc_id, and never more than four times that.  The pool is every other
document: its features are written once, each round's confident share is cut off at distributed quantiles of the scores
(equal scores by the hash of the doc_id), and each Newton step adds sums over all documents handed over so far to those over the
labelled ones.  The driver holds the labelled features and sums, whatever the pool.  Scoring reads every text, whole.
Features of a text are sums over fixed-size pieces of bytes, so a very long text needs no more memory than its own length.

Null and empty texts have a text view of zeros; null source, lang and n_chars are values of their own; a doc_id
that labels hold several times has the rounded mean of its labels; null labels and ids are not learnt from.  Without
labels of both classes every score is 0.5.  Rows come back one for one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bytehash
from textloom.llm.common import Scratch, arrow_map, read

SAMPLE, ROUNDS, SHARE, SEED = 6000, 5, 0.05, 23
#: Relative error in rank of the quantiles of scores is one in ACCURACY; a Newton step's sums come from PARTS tasks at most.
ACCURACY, PARTS = 100_000, 64
#: How far weights may still move when a round ends, and the last one.
COARSE, FINE = 1e-3, 1e-6
#: Which view labels for which.
OTHER = {"text": "meta", "meta": "text"}
_CLASS = np.full(256, 7, np.uint8)
for _k, _range in enumerate([[0x20], [0x09, 0x0A, 0x0B, 0x0C, 0x0D], range(97, 123), range(65, 91), range(48, 58), b".,;:!?'\"-()", b"#$%&*+/<=>@[\\]^_`{|}~"]):
    _CLASS[list(_range)] = _k
_CLASS[128:] = 8
CLASSES, WORD_BUCKETS, SOURCE_BUCKETS, LANG_BUCKETS = 9, 256, 64, 16
TEXT_DIM, META_DIM = CLASSES + 6 + WORD_BUCKETS, SOURCE_BUCKETS + LANG_BUCKETS + 12


def text_view(column: pa.Array) -> np.ndarray:
    data, offsets = bytehash.buffers(column)
    out = np.zeros((len(column), TEXT_DIM), np.float32)
    for i, j in bytehash.pieces(offsets):
        at = offsets[i : j + 1]
        size = np.diff(at)
        if not size.sum():
            continue
        n = j - i
        owner = np.repeat(np.arange(n, dtype=np.int64), size)
        count = np.bincount(owner * CLASSES + _CLASS[data[at[0] : at[-1]]], minlength=n * CLASSES).reshape(n, CLASSES)
        h, first = bytehash.words(data, at)
        words = np.diff(first)
        owner = np.repeat(np.arange(n, dtype=np.int64), words)
        bucket = (h >> np.uint64(56)).astype(np.int64)
        tf = np.bincount(owner * WORD_BUCKETS + bucket, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
        x = out[i:j]
        some = np.maximum(size, 1)[:, None]
        x[:, :CLASSES] = count / some * 4
        w = np.maximum(words, 1)
        x[:, CLASSES] = np.log1p(size) / 10
        x[:, CLASSES + 1] = np.log1p(words) / 10
        x[:, CLASSES + 2] = np.minimum(size / w, 40) / 10
        x[:, CLASSES + 3] = (tf > 0).sum(1) / np.minimum(w, WORD_BUCKETS)
        x[:, CLASSES + 4] = tf.max(1) / w
        same = np.zeros(len(h) + 1, np.int64)  # words that repeat the one before
        if len(h) > 1:
            same[1:-1] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        x[:, CLASSES + 5] = np.diff(np.concatenate([[0], np.cumsum(same)])[first]) / w
        x[:, CLASSES + 6 :] = np.sqrt(tf / w[:, None])
    return out


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    out = np.zeros((len(source), META_DIM), np.float32)
    for k, (s, g, n) in enumerate(zip(source, lang, n_chars)):
        out[k, _bucket(s, SOURCE_BUCKETS)] = 1
        out[k, SOURCE_BUCKETS + _bucket(g, LANG_BUCKETS)] = 1
        at = SOURCE_BUCKETS + LANG_BUCKETS
        if n is None:
            out[k, at + 11] = 1
        else:
            out[k, at + min(max(int(n), 0).bit_length() // 2, 9)] = 1
            out[k, at + 10] = np.log1p(max(int(n), 0)) / 10
    return out


_BUCKETS: dict = {}


def _bucket(x, n: int) -> int:
    if (x, n) not in _BUCKETS:
        if len(_BUCKETS) > 100_000:
            _BUCKETS.clear()
        h = 1469598103934665603
        for c in ("\x00" if x is None else str(x)).encode("utf-8", "surrogatepass"):
            h = (h ^ c) * 1099511628211 % (1 << 64)
        _BUCKETS[x, n] = (h >> 20) % n
    return _BUCKETS[x, n]


class Logistic:
    """Logistic regression with an L2 penalty, fitted by Newton steps; a and b calibrate its log-odds."""

    def __init__(self, penalty: float):
        self.penalty, self.w, self.a, self.b = penalty, None, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        fit({"": self}, {"": (x, y)})

    def raw(self, x: np.ndarray) -> np.ndarray:
        return x @ self.w[:-1] + self.w[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        curve = Logistic(1e-3)
        curve.fit(self.raw(x)[:, None], y)
        self.a, self.b = max(float(curve.w[0]), 1e-3), float(curve.w[1])

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * self.raw(x) + self.b, -30, 30)


def newton_sums(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the loss over rows, without the penalty."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1).astype(np.float64)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (p - y), (x * (p * (1 - p) + 1e-6)[:, None]).T @ x


def fit(models: dict[str, Logistic], own: dict, more=None, tolerance: float = 1e-6) -> None:
    """Fits models by name on rows own (x, y) and on those that more(weights) has sums of: name to gradient and Hessian.

    A model is done when no weight moved by the tolerance.
    """
    at = {k: np.zeros(own[k][0].shape[1] + 1) if m.w is None or more is None else m.w for k, m in models.items()}
    todo = set(at)
    for _ in range(25):
        far = more({k: at[k] for k in todo}) if more else {}
        for k in sorted(todo):
            ridge = np.full(len(at[k]), models[k].penalty)
            ridge[-1] = 1e-6
            g, h = newton_sums(at[k], *own[k])
            if k in far:
                g, h = g + far[k][0], h + far[k][1]
            step = np.linalg.solve(h + np.diag(ridge), g + ridge * at[k])
            at[k] = at[k] - step
            if np.abs(step).max() < tolerance:
                todo.discard(k)
        if not todo:
            break
    for k, m in models.items():
        m.w = at[k]


class CoTrained:
    def __init__(self, text: Logistic, meta: Logistic, prior: float):
        self.text, self.meta, self.prior = text, meta, prior

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.log_odds(xt), self.meta.log_odds(xm)
        return tuple(1 / (1 + np.exp(-z)) for z in (a, b, a + b - self.prior))


def keys(w: np.ndarray, x: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Log-odds, told apart by tie where they are equal."""
    return x @ w[:-1] + w[-1] + 1e-6 * tie


def handed(rounds: list, views: dict, tie: np.ndarray) -> dict:
    """For each view the label that the other one has given each row in these rounds, NaN for none; a round has w, low and high for each view."""
    out = {k: np.full(len(tie), np.nan) for k in OTHER}
    for bounds in rounds:
        for k, other in OTHER.items():
            w, low, high = bounds[k]
            key, free = keys(w, views[k], tie), np.isnan(out[other])
            out[other][free & (key >= high)] = 1
            out[other][free & (key <= low)] = 0
    return out


def _rows(batch, *names) -> list:
    dims = {"text": TEXT_DIM, "meta": META_DIM}
    return [np.frombuffer(b"".join(batch.column(n).to_pylist()), np.float32).reshape(-1, dims[n]) for n in names]


def _free_keys(rounds: list, weights: dict):
    """A column for each view: the keys of rows that it may still hand over."""

    def run(batches):
        for batch in batches:
            views, tie = dict(zip(OTHER, _rows(batch, *OTHER))), batch.column("tie").to_numpy()
            taken = handed(rounds, views, tie)
            yield pa.RecordBatch.from_arrays([pa.array(keys(weights[k], views[k], tie), mask=~np.isnan(taken[other])) for k, other in OTHER.items()], list(OTHER))

    return run


def _newly_handed(rounds: list):
    def run(batches):
        for batch in batches:
            views, tie = dict(zip(OTHER, _rows(batch, *OTHER))), batch.column("tie").to_numpy()
            before, now = handed(rounds[:-1], views, tie), handed(rounds, views, tie)
            for k in OTHER:
                at = np.flatnonzero(np.isnan(before[k]) & ~np.isnan(now[k]))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(now[k][at], pa.float64()),
                    pa.array([views[k][i].tobytes() for i in at], pa.binary())], ["view", "label", "x"])

    return run


def _partial_sums(weights: dict):
    """One row for each view: rows, gradient and Hessian of a task."""

    def run(batches):
        sums = {k: [0, np.zeros(len(w)), np.zeros((len(w), len(w)))] for k, w in weights.items()}
        for batch in batches:
            view, y = np.array(batch.column("view").to_pylist()), batch.column("label").to_numpy()
            x = batch.column("x").to_pylist()
            for k, total in sums.items():
                at = np.flatnonzero(view == k)
                if len(at):
                    rows = np.frombuffer(b"".join(x[i] for i in at), np.float32).reshape(len(at), -1)
                    for i, part in enumerate((len(at), *newton_sums(weights[k], rows, y[at]))):
                        total[i] += part
        for k, (n, g, h) in sums.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([n], pa.int64()), pa.array([g.tobytes()], pa.binary()), pa.array([h.tobytes()], pa.binary())],
                    ["view", "n", "g", "h"])

    return run


def co_train(xt, xm, y, pool: DataFrame, scratch: Scratch) -> CoTrained | None:
    """xt, xm, y: views and labels of the labelled; pool: text, meta (views as float32 bytes) and tie of all others."""
    kept_out = np.arange(len(y)) % 4 == 3
    if len(set(y[~kept_out].tolist())) < 2 or len(set(y[kept_out].tolist())) < 2:
        return None
    models = {"text": Logistic(3.0), "meta": Logistic(3.0)}
    own = {"text": (xt[~kept_out], y[~kept_out]), "meta": (xm[~kept_out], y[~kept_out])}
    good, size = own["text"][1].mean(), pool.count()
    take = max(1, int(SHARE * size))
    rounds: list = []
    tables: list = []
    free = dict.fromkeys(OTHER, size)
    fit(models, own)

    def more(weights):
        picked = tables[0]
        for t in tables[1:]:
            picked = picked.unionAll(t)
        out = {}
        for r in arrow_map(picked.coalesce(PARTS), _partial_sums(weights), "view string, n long, g binary, h binary").collect():
            g, h = np.frombuffer(r["g"]), np.frombuffer(r["h"]).reshape(-1, len(weights[r["view"]]))
            a, b = out.get(r["view"], (0, 0))
            out[r["view"]] = (a + g, b + h)
        return out

    for r in range(ROUNDS if size else 0):
        weights, ask = {k: m.w for k, m in models.items()}, {}
        for k, other in OTHER.items():
            n_good = min(max(1, round(take * good)), free[other] // 2)
            n_bad = min(max(1, take - n_good), free[other] - n_good)
            ask[k] = (n_bad, n_good, max(free[other], 1))
        at = [F.percentile_approx(k, [max(n_bad - 0.5, 0.0) / n, min(n - n_good + 0.5, n) / n], ACCURACY).alias(k) for k, (n_bad, n_good, n) in ask.items()]
        cut = arrow_map(pool, _free_keys(rounds, weights), "text double, meta double").agg(*at).first()
        rounds.append({k: (weights[k], cut[k][0] if cut[k] and ask[k][0] else -np.inf, cut[k][1] if cut[k] and ask[k][1] else np.inf) for k in OTHER})
        tables.append(scratch.write(arrow_map(pool, _newly_handed(list(rounds)), "view string, label double, x binary"), "handed", narrow=True))
        for row in tables[-1].groupBy("view").count().collect():
            free[row["view"]] -= row["count"]
        fit(models, own, more, COARSE if r < ROUNDS - 1 else FINE)
    scratch.drop(*tables)
    models["text"].calibrate(xt[kept_out], y[kept_out])
    models["meta"].calibrate(xm[kept_out], y[kept_out])
    return CoTrained(models["text"], models["meta"], float(np.log(good / (1 - good))))


def _features(batches):
    for batch in batches:
        xt = text_view(batch.column(1))
        xm = meta_view(*(batch.column(k).to_pylist() for k in (2, 3, 4)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), batch.column(6), pa.array([r.tobytes() for r in xt], pa.binary()),
            pa.array([r.tobytes() for r in xm], pa.binary())], ["doc_id", "label", "tie", "text", "meta"])


def train(docs: DataFrame, labels: DataFrame) -> CoTrained | None:
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("int").alias("label"))
    known = labels.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not known:
        return None
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    # labelled documents by their share of the labels, at most SAMPLE rows; all others are the pool
    labels = labels.where(draw < min(1.0, SAMPLE / known)).limit(2 * SAMPLE)
    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    labelled = rows.join(F.broadcast(labels), "doc_id")
    pool = rows.where("doc_id is not null").join(F.broadcast(labels.select("doc_id")), "doc_id", "left_anti").withColumn("label", F.lit(None).cast("int"))
    kind = dict(rows.dtypes)["doc_id"]

    def features(part: DataFrame) -> DataFrame:
        part = part.select("doc_id", "text", "source", "lang", "n_chars", "label",
            F.pmod(F.xxhash64(F.lit(SEED + 1), F.col("doc_id").cast("string")), F.lit(1 << 30)).cast("double").alias("tie"))
        return arrow_map(part.withColumn("tie", F.col("tie") / float(1 << 30)), _features, f"doc_id {kind}, label int, tie double, text binary, meta binary")

    got = features(labelled.limit(4 * SAMPLE)).collect()  # more only where a doc_id has very many rows
    got.sort(key=lambda r: str(r["doc_id"]))
    if not got:
        return None
    xt = np.stack([np.frombuffer(r["text"], np.float32) for r in got])
    xm = np.stack([np.frombuffer(r["meta"], np.float32) for r in got])
    y = np.array([min(max(r["label"], 0), 1) for r in got], np.float64)
    scratch = Scratch(docs.sparkSession)
    pool = scratch.write(features(pool).select("tie", "text", "meta"), "pool")
    model = co_train(xt, xm, y, pool, scratch)
    scratch.drop(pool)
    return model


def _score(model: CoTrained | None):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            a = b = c = np.full(n, 0.5)
            if model:
                a, b, c = model.scores(text_view(batch.column(1)), meta_view(*(batch.column(k).to_pylist() for k in (2, 3, 4))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.asarray(x, np.float64)) for x in (a, b, c))],
                ["doc_id", "text_score", "meta_score", "score"])

    return run


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """doc_id, text_score, meta_score and score (the chance of good quality) for each row of docs."""
    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    kind = dict(rows.dtypes)["doc_id"]
    return arrow_map(rows, _score(model), f"doc_id {kind}, text_score double, meta_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
