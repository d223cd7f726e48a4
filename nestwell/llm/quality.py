"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors."""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestwell.llm._common import Workspace, frugal, id_and_text, unused

#: Rows that train the scorer, at most, and the size of its hashed feature space.
TRAIN_ROWS, DIMS = 8_192, 1 << 12
_ODD = frozenset("#$%&*@^~<>{}|\\=!")
_RUN = re.compile(r"(.)\1+")


class _Fold(dict):
    """Letters by case, digits as 0 and other characters as they are; those beyond Latin-1 are found when first met."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        found = "A" if x.isupper() else "a" if x.isalpha() else "0" if x.isalnum() else x
        if len(self) < 1 << 16:
            self[c] = found
        return found


#: Known for Latin-1 from the start.
_FOLD = _Fold()
for _c in range(256):
    _FOLD[_c]
#: Labellers: each calls a text bad from its first bound on and good below its second, and abstains between.
LABELLERS = {
    "odd_marks": (0.3, 0.05),
    "odd_ends": (0.25, 0.04),
    "capitals": (0.5, 0.2),
    "shouts": (0.2, 0.03),
    "stutter": (0.2, 0.05),
    "sameness": (0.75, 0.6),
    "one_word": (0.2, 0.12),
    "bare_marks": (0.15, 0.02),
    "no_sentences": (0.995, 0.98),
    "same_lines": (0.4, 0.1),
}
_words: dict[str, tuple] = {}


def _feature(shape: str) -> int:
    return zlib.crc32(shape.encode("utf-8", "surrogatepass")) % DIMS


_LOWER, _TITLE = _feature("a"), _feature("Aa")


def _word(w: str) -> tuple:
    """(feature, flags or None) of a whole word, kept up to a bounded number if short; flags are odd marks, ends oddly, all
    capitals, shouts, bare, ends a sentence."""
    found = _words.get(w)
    if found is None:
        odd = sum(c in _ODD for c in w)
        flags = (odd, w[-1] in _ODD, w.isupper() and len(w) > 1, w[-1] == "!", not any(map(str.isalnum, w)), w[-1] in ".?")
        found = (_feature(_RUN.sub(r"\1", w.translate(_FOLD))), flags if any(flags) else None)
        if len(_words) >= 50_000:
            _words.clear()
        if len(w) <= 64:
            _words[w] = found
    return found


def forget() -> None:
    _words.clear()


def measure(text: str) -> tuple[int, list[float], dict[int, float]]:
    """Words of a whole text, what each labeller looks at, and hashed features with their values.

    Features are the shapes of words (letters folded by case, digits to 0, runs to one), each the root of
    its share, and the labellers' measures in tenths.
    """
    words = text.split()
    n = len(words)
    if not n:
        return 0, [1.0] * len(LABELLERS), {}
    counts = Counter(words)
    sums, out, lower, title = [0] * 6, {}, 0, 0
    for w, c in counts.items():
        if w.isalpha():  # most words: their shape shows at once
            if w.islower():
                lower += c
                continue
            if w.istitle() and len(w) > 1:
                title += c
                continue
        k, flags = _word(w)
        out[k] = out.get(k, 0) + c
        if flags:
            for j, f in enumerate(flags):
                if f:
                    sums[j] += f * c
    for k, c in ((_LOWER, lower), (_TITLE, title)):
        if c:
            out[k] = out.get(k, 0) + c
    odd, ends, capital, shouts, bare, stops = (x / n for x in sums)
    again = sum(map(operator.eq, words, islice(words, 1, None))) / n
    long = n > 30
    lines = [x for x in text.split("\n") if x]
    same = 1 - len(set(lines)) / len(lines) if len(lines) > 4 else 0.0
    seen = [odd, ends, capital, shouts, again, 1 - len(counts) / n if long else 0.0, max(counts.values()) / n if long else 0.0, bare, 1 - stops if long else 0.0, same]
    feats = {k: (c / n) ** 0.5 for k, c in out.items()}
    for name, v in zip(LABELLERS, seen, strict=True):
        k = zlib.crc32(f"{name} {min(9, int(v * 10))}".encode()) % DIMS
        feats[k] = feats.get(k, 0.0) + 0.5
    return n, seen, feats


def vote(seen: list[float]) -> list[int]:
    """1 says good, 0 bad, -1 abstains; labellers overlap on purpose, and the model weighs them."""
    return [0 if v >= bad else 1 if v < good else -1 for v, (bad, good) in zip(seen, LABELLERS.values(), strict=True)]


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, prior: float = 0.85) -> dict:
    """EM for labellers that err independently given the hidden class.

    ``patterns`` (p, m) holds every combination of votes that occurs, ``counts`` how many documents have it.
    For each labeller and class it finds how often each vote is given.  It starts from labellers that seldom
    call a good text bad and overlook most bad ones, as each knows one fault only; so class 1 stays the good
    one.  Counts are smoothed.
    """
    m = patterns.shape[1]
    table = np.empty((2, m, 3))  # class, labeller, vote + 1
    table[0] = [0.2, 0.35, 0.45]
    table[1] = [0.17, 0.03, 0.8]
    hot = np.stack([patterns == v for v in (-1, 0, 1)], 2).astype(float)
    posterior = np.full(len(patterns), prior)
    for _ in range(rounds):
        log = np.einsum("pmv,cmv->cp", hot, np.log(table)) + np.log([[1 - prior], [prior]])
        after = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        weights = np.stack([1 - after, after]) * counts
        table = np.einsum("cp,pmv->cmv", weights, hot) + 1.0
        table /= table.sum(2, keepdims=True)
        prior = float(np.clip(weights[1].sum() / max(1e-9, counts.sum()), 0.01, 0.99))
        if np.abs(after - posterior).max(initial=0) < 1e-7:
            break
        posterior = after
    voted = np.maximum(1e-9, table[:, :, 1:].sum(2))
    return {"posterior": posterior, "table": table, "prior": prior, "accuracy": (table[0, :, 1] / voted[0] + table[1, :, 2] / voted[1]) / 2}


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, epochs: int = 300, rate: float = 2.0, decay: float = 1e-4) -> np.ndarray:
    """Weights (DIMS and a bias) of logistic regression on soft targets, by full-batch gradient steps with momentum.

    ``rows`` are features and values; their arrays stay as small as they came, so TRAIN_ROWS texts with all DIMS features are some 350 MB.
    """
    w, speed = np.zeros(DIMS + 1), np.zeros(DIMS + 1)
    if not len(rows):
        return w
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(k) for k, _ in rows])
    col, val = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])
    weight = np.where(targets > 0.5, 0.5 / max(1.0, targets.sum()), 0.5 / max(1.0, (1 - targets).sum()))
    for _ in range(epochs):
        z = np.bincount(row, val * w[col], len(rows)) + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - targets) * weight
        grad = np.append(np.bincount(col, val * error[row], DIMS), error.sum()) + decay * w
        speed = 0.9 * speed - rate * grad
        w = w + speed
    return w


#: What a measured text is kept as: words, votes, and its features in order with their values.
_MEASURED = ("n_words", "ballot", "keys", "values")
_VOTES = {-1: "?", 0: "-", 1: "+"}


def _arrays(keys: bytes, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(keys, "<u2"), np.frombuffer(values, "<f8")


def _measured(ws: Workspace, rows: DataFrame, text_col: str, names: list[str]) -> DataFrame:
    """``rows`` with the whole text measured, once, and staged: what training and scoring read; ``names`` are the new columns'."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in zip(names, (T.LongType(), T.StringType(), T.BinaryType(), T.BinaryType()), strict=True)]])
    where = rows.columns.index(text_col)

    def run(batches):
        for batch in batches:
            n, ballots, keys, values = [], [], [], []
            for x in batch.column(where):
                words, seen, feats = measure(str(x.as_py() or ""))
                order = sorted(feats)
                n.append(words)
                ballots.append("".join(_VOTES[v] for v in vote(seen)))
                keys.append(np.array(order, "<u2").tobytes())
                values.append(np.array([feats[k] for k in order], "<f8").tobytes())
            made = [pa.array(n, pa.int64()), pa.array(ballots, pa.string()), pa.array(keys, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *names])

    return ws.stage(rows.mapInArrow(frugal(run, forget), schema), "measured")


def fit(measured: DataFrame, hashes: Column, names: list[str], train_rows: int = TRAIN_ROWS) -> dict:
    """The label model and the scorer from staged measures.  Votes of all documents are counted; only their combinations (3**10 at most) reach the driver.

    The scorer learns from the ``train_rows`` distinct texts of the least hash, with the posterior of their
    combination of votes: a bounded, documented sample, the same whatever the order of rows.
    """
    _, ballot, keys, values = names
    found = measured.groupBy(F.col(ballot).alias("ballot")).agg(F.count("*").alias("n")).collect()
    patterns = np.array([["-+".find(c) for c in r["ballot"]] for r in found], np.int64).reshape(-1, len(LABELLERS))
    model = fit_labellers(patterns, np.array([r["n"] for r in found], float))
    posterior = {r["ballot"]: q for r, q in zip(found, model["posterior"], strict=True)}
    hashed = measured.select(hashes.alias("h"), F.col(ballot).alias("ballot"), F.col(keys).alias("k"), F.col(values).alias("v"))
    bound = hashed.select("h").distinct().orderBy("h").limit(train_rows).agg(F.max("h")).first()[0]
    sample = [] if bound is None else hashed.filter(F.col("h") <= bound).dropDuplicates(["h"]).collect()
    sample.sort(key=lambda r: r["h"])
    model["weights"] = fit_scorer([_arrays(r["k"], r["v"]) for r in sample], np.array([posterior[r["ballot"]] for r in sample]))
    return model


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """The model of ``fit`` for ``docs``, whose texts are measured for it alone."""
    ws = Workspace(docs.sparkSession, "quality_train")
    rows = id_and_text(docs, id_col, text_col, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("h"))
    measured = _measured(ws, rows, "text", list(_MEASURED))
    model = fit(measured, F.col("h"), list(_MEASURED), train_rows)
    ws.close()
    return model


def _quality(keys: bytes, values: bytes, w: list[float]) -> float:
    """0 for a text without words; features come in order, so sums repeat to the bit."""
    if not keys:
        return 0.0
    k, v = _arrays(keys, values)
    z = w[-1] + sum(w[i] * x for i, x in zip(k.tolist(), v.tolist(), strict=True))
    return round(float(1 / (1 + np.exp(-np.clip(z, -50, 50)))), 6)


def _scores(keys: Column, values: Column, weights) -> Column:
    """The scorer as a column over packed features, in Arrow batches."""

    @F.pandas_udf("double")
    def run(k: pd.Series, v: pd.Series) -> pd.Series:
        w = weights.value.tolist()
        return pd.Series([_quality(a, b, w) for a, b in zip(k, v, strict=True)], dtype=float)

    return run(keys, values)


def score(docs: DataFrame, model: dict, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, quality (0 to 1) and accepted by a model trained before: one row per input row, whole texts."""
    ws = Workspace(docs.sparkSession, "quality_score")
    return _scored(_measured(ws, id_and_text(docs, id_col, text_col), "text", list(_MEASURED)), model, threshold)


def _scored(measured: DataFrame, model: dict, threshold: float) -> DataFrame:
    weights = measured.sparkSession.sparkContext.broadcast(model["weights"])
    quality = _scores(F.col("keys"), F.col("values"), weights)
    return measured.select("doc_id", "n_words", quality.alias("quality")).withColumn("accepted", F.col("quality") >= threshold)


def classify(docs: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, quality, accepted, from labellers alone: no labelled row is needed.

    Ten heuristic labellers vote on every document or abstain; expectation-maximisation over the counts
    of all vote combinations estimates their accuracies and each combination's posterior; a logistic
    scorer over hashed word shapes is trained on these and scores every whole text.  Each text is measured
    once; its votes and features are staged for both.

    Null and wordless texts have quality 0 and are rejected; a null id stays null; repeated rows give
    repeated rows with equal scores; an empty table gives an empty one; other columns are ignored.
    """
    ws = Workspace(docs.sparkSession, "quality")
    rows = id_and_text(docs, id_col, text_col, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("h"))
    made = _measured(ws, rows, "text", list(_MEASURED))
    return _scored(made, fit(made, F.col("h"), list(_MEASURED), train_rows), threshold)


def drop_rejected(docs: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The accepted documents, with the columns of ``docs``: rows are staged with their measures and filtered there, without a join.

    Every row is judged by its own text, so ids that are null or shared lose nothing; null and wordless texts
    go; repeated rows share their fate; columns may have any names; an empty table gives an empty one.
    """
    ws, names = Workspace(docs.sparkSession, "drop_rejected"), unused(docs.columns, *_MEASURED)
    made = _measured(ws, docs, text_col, names)
    model = fit(made, F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), names, train_rows)
    weights = docs.sparkSession.sparkContext.broadcast(model["weights"])
    return made.filter(_scores(F.col(names[2]), F.col(names[3]), weights) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
