"""Quality classifier by co-training on two views of a document.

One view is the text (shares of characters, words and lines), the other the page's
metadata (language, source, length). Each view has a logistic regression; over some
rounds each labels the unlabelled documents it is surest of for the other. The two,
calibrated on labelled documents kept back, are combined and score all documents.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Most labelled and unlabelled documents that the fit looks at, chosen by hash of their id.
LABELLED, POOL = 12_000, 12_000
ROUNDS, SURE, SHARE = 5, 0.97, 0.1
SOURCE_SLOTS, LANG_SLOTS, LENGTH_SLOTS = 32, 8, 12
#: A document is rejected if its probability of good quality is below this.
THRESHOLD = 0.5

_MARKS = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)


def text_features(text: str) -> np.ndarray:
    """Shares of the whole text; all zero but the first for an empty one."""
    raw = np.frombuffer(text.encode(), np.uint8)
    n = max(1, len(raw))
    by = np.bincount(raw, minlength=256) / n
    words = text.split()
    k = max(1, len(words))
    lines = text.splitlines()
    counts = Counter(words)
    ends = Counter(w[-1] for w in words)
    shares = [
        1.0 if not words else 0.0,
        by[65:91].sum(),
        by[97:123].sum(),
        by[48:58].sum(),
        by[128:].sum(),
        by[10],
        by[32],
        sum(map(str.isupper, words)) / k,
        sum(map(str.isalpha, words)) / k,
        len(counts) / k,
        max(counts.values(), default=0) / k,
        sum(v for c, v in ends.items() if not c.isalnum() and c not in ".,") / k,
        len(set(lines)) / max(1, len(lines)),
        ends.get(".", 0) / k,
        ends.get(",", 0) / k,
    ]
    scales = [np.log1p(k) / 10, np.log1p(sum(map(len, words)) / k), np.log1p(k / max(1, len(lines))) / 5, np.log1p(max(map(len, words), default=0)) / 5]
    shares = np.concatenate((shares, by[_MARKS]))
    return np.concatenate((shares, np.log(shares + 1e-3) / 7, scales))


def meta_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANG_SLOTS + SOURCE_SLOTS + LENGTH_SLOTS + 2)
    out[zlib.crc32((lang or "").encode()) % LANG_SLOTS] = 1
    out[LANG_SLOTS + zlib.crc32((source or "").encode()) % SOURCE_SLOTS] = 1
    size = np.log2(max(0, n_chars or 0) + 1)
    out[LANG_SLOTS + SOURCE_SLOTS + min(LENGTH_SLOTS - 1, int(size / 1.5))] = 1
    out[-2:] = size / 16, n_chars is None
    return out


class Logistic:
    """L2-regularised logistic regression by Newton steps, on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.std = x.mean(0), np.maximum(x.std(0), 1e-4)
        a = self._design(x)
        w = np.zeros(a.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty)
            step = np.linalg.solve(h, a.T @ (y - p) - penalty * w)
            w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-6:
                break
        self.w = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        # Beyond eight deviations a feature says no more.
        return np.hstack((np.clip((x - self.mean) / self.std, -8, 8), np.ones((len(x), 1))))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._design(x) @ self.w


class CoTrained:
    """Both views' regressions after the rounds, their calibrations and their combination."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray]):
        kept = np.arange(len(y)) % 4 == 3  # every fourth labelled document calibrates
        own = [[(x[~kept], y[~kept].astype(float))] for x in views]
        free = np.ones(len(pool[0]), bool)
        for _ in range(ROUNDS):
            models = [Logistic(*(np.concatenate(p) for p in zip(*parts, strict=True))) for parts in own]
            for k in (0, 1):
                p = 1 / (1 + np.exp(-np.clip(models[k].logit(pool[k]), -30, 30)))
                for label, sure in ((1.0, p), (0.0, 1 - p)):
                    at = np.flatnonzero(free & (sure >= SURE))
                    # The surest share of each class goes to the other view.
                    at = at[np.argsort(-sure[at], kind="stable")][: int(SHARE * (sure > 0.5).sum()) + 1]
                    free[at] = False
                    if len(at):
                        own[1 - k].append((pool[1 - k][at], np.full(len(at), label)))
        self.models = [Logistic(*(np.concatenate(p) for p in zip(*parts, strict=True))) for parts in own]
        logits = [m.logit(x[kept])[:, None] for m, x in zip(self.models, views, strict=True)]
        self.calibration = [Logistic(z, y[kept]) for z in logits]
        self.combined = Logistic(np.hstack([c.logit(z)[:, None] for c, z in zip(self.calibration, logits, strict=True)]), y[kept])

    def score(self, views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Columns: probability of good quality by text, by metadata, and combined."""
        z = [c.logit(m.logit(x)[:, None]) for m, c, x in zip(self.models, self.calibration, views, strict=True)]
        both = self.combined.logit(np.stack(z, 1))
        return 1 / (1 + np.exp(-np.clip(np.stack([*z, both], 1), -30, 30)))


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    text, lang, source, n_chars = (batch.column(c).to_pylist() for c in ("text", "lang", "source", "n_chars"))
    return (
        np.array([text_features(t or "") for t in text]).reshape(len(text), -1),
        np.array([meta_features(*m) for m in zip(lang, source, n_chars, strict=True)]).reshape(len(text), -1),
    )


def _columns(docs: DataFrame) -> DataFrame:
    """doc_id and the columns that the views read; what is missing is null."""
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL) -> CoTrained | None:
    """Co-train on at most ``labelled`` labelled and ``pool`` unlabelled documents; None without both classes.

    Documents with contradictory labels count as poor; null labels are passed over.
    """
    chance = lambda share: F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < F.lit(min(1.0, share) * 1_000_003)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = known.where(chance(labelled / max(1, known.count()))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    rows = _columns(docs).where("doc_id is not null")
    near = rows.join(F.broadcast(some), "doc_id", "left")  # at most `labelled` ids
    near = near.where(F.col("quality").isNotNull() | chance(pool / max(1, rows.count())))

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            text, meta = _views(batch)
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("quality").cast(pa.int32()), pa.array(list(text), pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64()))],
                ["doc_id", "quality", "by_text", "by_meta"],
            )

    found = near.mapInArrow(run, "doc_id long, quality int, by_text array<double>, by_meta array<double>")
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", "by_text").limit(labelled + 2 * pool).collect()
    have, free = [r for r in rows if r["quality"] is not None], [r for r in rows if r["quality"] is None]
    y = np.array([r["quality"] for r in have], float)
    if len(np.unique(y[np.arange(len(y)) % 4 != 3])) < 2 or len(np.unique(y[np.arange(len(y)) % 4 == 3])) < 2:
        return None
    views = [tuple(np.array([r[c] for r in part]) for c in ("by_text", "by_meta")) for part in (have, free or have[:1])]
    return CoTrained(views[0], y, views[1])


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, p_text, p_meta, p_quality (probabilities of good quality) and keep.

    Null text is empty, missing or null metadata is a value of its own, repeated rows have equal
    scores, null ids stay. If the labels have one class or none, all scores are null and all are kept.
    """
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            p = shared.value.score(_views(batch)) if shared.value else None
            scores = [pa.array(p[:, k]) if p is not None else pa.nulls(batch.num_rows, pa.float64()) for k in range(3)]
            keep = pa.array(p[:, 2] >= threshold if p is not None else np.ones(batch.num_rows, bool))
            yield pa.record_batch([batch.column("doc_id"), *scores, keep], ["doc_id", "p_text", "p_meta", "p_quality", "keep"])

    return _columns(docs).mapInArrow(run, "doc_id long, p_text double, p_meta double, p_quality double, keep boolean")


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose quality is not rejected; no shuffle of texts.

    Rows are judged as in ``score_quality``: repeated rows alike, rows with null ids and texts too; with
    labels of one class or none all stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    needed = ["text", "lang", "source", "n_chars"]
    missing = [c for c in needed if c not in docs.columns]

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            if shared.value is None:
                yield batch
                continue
            views = pa.Table.from_batches([batch]).select([c for c in needed if c not in missing])
            for c in missing:
                views = views.append_column(c, pa.nulls(batch.num_rows))
            p = shared.value.score(_views(views.combine_chunks()))
            yield batch.filter(pa.array(p[:, 2] >= threshold))

    return docs.mapInArrow(run, docs.schema)
