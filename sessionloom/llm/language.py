"""Language identification in two levels: the family, then the language within it.

Texts become hashed byte-trigram profiles of the whole text. Linear support
vector machines, one for each pair of families, vote for a family; those for
each pair of languages in it vote for the language.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionloom.llm.common import importable, slices

#: Rows that the model is fitted on at most, all languages together; equally many of each, by hashed id.
MAX_SAMPLE = 4_000
BUCKETS = 4096
FOLDS = 5

#: Families of languages by their codes; a code that is not here is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "indic": "bn gu hi mr ne pa si ur",
    "turkic": "az kk ky tr uz",
    "sinitic": "wuu yue zh",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY_OF.get(lang, lang)


def profile(text: str) -> np.ndarray:
    """The text's byte trigrams, lower-cased, hashed to `BUCKETS`; square roots of shares, so of length 1."""
    raw = np.frombuffer(f" {text.lower()} ".encode(), dtype=np.uint8).astype(np.uint32)
    code = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
    count = np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=BUCKETS)
    return np.sqrt(count / max(len(code), 1)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30) -> tuple[np.ndarray, float]:
    """A linear SVM for labels +1 and -1 by dual coordinate descent; the bias is a constant feature."""
    rng = np.random.default_rng(7)
    norm = (x * x).sum(axis=1) + 1.0
    weight, bias, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(y))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (x[i] @ weight + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                weight += step * x[i]
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weight, bias


class Votes:
    """One-versus-one machines between groups of labels."""

    def __init__(self, x: np.ndarray, labels: np.ndarray):
        self.names = sorted(set(labels.tolist()))
        self.pairs = list(itertools.combinations(range(len(self.names)), 2))
        weight, bias = [], []
        for a, b in self.pairs:
            rows = np.flatnonzero((labels == self.names[a]) | (labels == self.names[b]))
            w, d = train_svm(x[rows], np.where(labels[rows] == self.names[a], 1.0, -1.0))
            weight.append(w)
            bias.append(d)
        self.weight = np.array(weight, dtype=np.float32).reshape(len(self.pairs), x.shape[1]).T
        self.bias = np.array(bias, dtype=np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The label number of most votes (then of most confidence, then the first) and its mean confidence."""
        if len(self.names) == 1:
            return np.zeros(len(x), dtype=np.int64), np.ones(len(x))
        sure = 1 / (1 + np.exp(-2.0 * (x @ self.weight + self.bias).astype(np.float64)))
        votes, total = np.zeros((len(x), len(self.names))), np.zeros((len(x), len(self.names)))
        for k, (a, b) in enumerate(self.pairs):
            votes[:, a] += sure[:, k] >= 0.5
            votes[:, b] += sure[:, k] < 0.5
            total[:, a] += sure[:, k]
            total[:, b] += 1 - sure[:, k]
        best = np.argmax(votes + total / (len(self.names) * 2), axis=1)
        return best, total[np.arange(len(x)), best] / (len(self.names) - 1)


class Model:
    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.n_rows = len(x)
        families = np.array([family(v) for v in lang])
        self.top = Votes(x, families)
        self.within = [Votes(x[families == f], lang[families == f]) for f in self.top.names]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if has_letter(t)]
        if rows:
            x = np.stack([profile(texts[i]) for i in rows])
            top, top_score = self.top.predict(x)
            for f, votes in enumerate(self.within):
                of = np.flatnonzero(top == f)
                if len(of):
                    best, score = votes.predict(x[of])
                    for k, b, s in zip(of.tolist(), best.tolist(), (score * top_score[of]).tolist(), strict=True):
                        names[rows[k]], scores[rows[k]] = votes.names[b], min(max(s, 0.0), 1.0)
        return names, scores


def _held_out(df: DataFrame, id_col: str) -> F.Column:
    return F.coalesce(F.crc32(df[id_col].cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_sample: int = MAX_SAMPLE) -> Model | None:
    """Learns from rows outside the held-out fold with a language, at most `max_sample`; None without any.

    The languages are counted first (the `max_sample` most frequent take part);
    a share of each one's rows, by a hash of id and text, then bounds what is
    read, and a rank by that hash what is sent to the driver as profiles.
    """
    importable(df.sparkSession)
    rows = df.where(~_held_out(df, id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_sample).collect()}
    if not counts:
        return None
    each = max(1, max_sample // len(counts))
    scale = 1 << 30
    share = F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(scale, int(scale * 1.3 * each / n) + 1))])
    hashed = rows.withColumn("h", F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = [i for i, t in enumerate(batch.column("text").to_pylist()) if has_letter(t)]
            part = batch.take(pa.array(keep, pa.int64()))
            found = [profile(t).astype(np.float16).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("h"), part.column("doc_id"), pa.array(found, pa.binary())], names=["lang", "h", "doc_id", "x"])

    # rows that are all alike have one hash, so a share may hold none of them; then all are ranked
    for chosen in (hashed.where(F.col("h") < share[F.col("lang")]), hashed):
        found = chosen.select("lang", "h", "doc_id", "text").mapInArrow(run, "lang string, h long, doc_id long, x binary")
        # the rank's limit is applied in each task before the shuffle too, so rows that share a hash cost no more than others
        ranked = found.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "x"))).where(F.col("nth") <= each)
        taken: dict[str, list] = {}
        for r in ranked.select("lang", "nth", "x").orderBy("lang", "nth").collect():
            taken.setdefault(r["lang"], []).append(np.frombuffer(r["x"], dtype=np.float16).astype(np.float32))
        if taken:
            break
    else:
        return None
    lang = np.array([k for k, v in taken.items() for _ in v])
    return Model(np.concatenate([np.stack(v) for v in taken.values()]), lang)


def language_id(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row, by its whole text alone.

    lang_pred is `und`, with score 0, for a null text, a text without letters,
    and without a model. Repeated rows give repeated results; a null id is not
    held out; an empty table gives an empty result. Nothing is shuffled.
    """
    importable(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), _held_out(df, id_col).alias("held_out"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            names, scores = model.predict(texts) if model else (["und"] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
