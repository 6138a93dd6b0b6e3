"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier on
byte n-grams separates the languages whose bit is set from the others: its
weights are log odds of n-gram frequencies, each language with equal mass, so
training is one aggregation. A text gives each bit a margin; decoding sums a
logistic loss of margin against codeword, weighted by how reliable the bit was
in training, and takes the codeword of least loss. The score is the softmax of
the negative losses; a text in which no codeword reaches half of it is
flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.llm.common import driver_table, fold_of
from framewright.session import reliable

UNKNOWN = "und"
# About as many training documents of each language, picked by a hash of the id.
DOCS_PER_LANGUAGE = 2_000
FEATURES = 2 << 16
SMOOTHING = 0.5
AMBIGUOUS = 0.5
# Languages up to which the exhaustive code is used.
EXHAUSTIVE = 7

# A-Z to lower case, all other ASCII but a-z to a blank; bytes of other letters stay.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_SLICE = 1 << 16
# Rows sent back at once.
_ROWS = 1_000


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, -1 or 1
    weights: np.ndarray  # features x bits
    scale: np.ndarray  # of the margins of each bit
    trust: np.ndarray  # weight of each bit's loss


def codewords(n: int, seed: int = 1) -> np.ndarray:
    """One row of -1 and 1 per language: all splits for few languages, else
    the best separated of some random dense codes."""
    if n <= 1:
        return np.ones((n, 0), dtype=np.float32)
    if n <= EXHAUSTIVE:
        splits = itertools.product((-1, 1), repeat=n - 1)
        bits = [(1, *s) for s in splits if -1 in s]
        return np.array(bits, dtype=np.float32).T
    rng, length = np.random.default_rng(seed), max(31, math.ceil(15 * math.log2(n)))
    best, apart = None, -1.0
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], dtype=np.float32), (n, length))
        distance = (length - code @ code.T) / 2 + length * np.eye(n)
        if distance.min() > apart and (abs(code.sum(axis=0)) < n).all():
            best, apart = code, distance.min()
    return best


def grams(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers of the byte pairs and (hashed) triples of a text, in slices."""
    a = np.frombuffer(b" " + text.translate(_LETTERS) + b"  ", dtype=np.uint8)
    for low in range(0, len(a) - 2, _SLICE):
        part = a[low : low + _SLICE + 2].astype(np.uint32)
        two = part[:-2] << 8 | part[1:-1]
        three = ((two << 8 | part[2:]) * np.uint32(2654435761)) >> 16
        yield two, three + 65536


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            own = totals.setdefault(lang.as_py(), np.zeros(FEATURES, dtype=np.int64))
            for pair in grams(text.as_py().encode("utf-8", "surrogatepass")):
                for numbers in pair:
                    own += np.bincount(numbers, minlength=FEATURES)
    for lang, own in totals.items():
        seen = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(seen)), pa.array(seen, pa.int32()), pa.array(own[seen])],
            names=["lang", "feature", "n"],
        )


def margins(model: Model, text: bytes) -> np.ndarray:
    total, n = np.zeros(model.weights.shape[1]), 0
    for two, three in grams(text):
        total += model.weights[two].sum(axis=0, dtype=np.float64)
        total += model.weights[three].sum(axis=0, dtype=np.float64)
        n += len(two)
    return total / max(n, 1) / model.scale


def decode(model: Model, margin: np.ndarray) -> np.ndarray:
    """Probability of each language: softmax of the negative weighted losses."""
    loss = np.logaddexp(0, -model.code * margin[None, :] * 4) @ model.trust
    p = np.exp(loss.min() - loss)
    return p / p.sum()


def train(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    per_language: int = DOCS_PER_LANGUAGE,
) -> Model:
    """Fit on about ``per_language`` rows of each language with text and label.

    The rows are those of the smallest hashes of the id: the share that gives
    ``per_language`` rows is fixed by a count, so no sort is needed, and the
    driver receives one number per language and n-gram bucket.
    """
    spark = docs.sparkSession
    labelled = docs.select(
        F.col(lang_col).cast("string").alias("lang"),
        F.col(text_col).alias("text"),
        # The text too, so that rows with null or repeated ids are spread like the others.
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("place"),
    ).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(counts)
    code = codewords(len(languages))
    bits = code.shape[1]
    flat = Model(languages, code, np.zeros((FEATURES, bits), np.float32), np.ones(bits), np.ones(bits))
    if bits == 0:
        return flat
    shares = driver_table(
        spark,
        [(x, min(1.0, per_language / counts[x])) for x in languages],
        pa.schema([("l", pa.string()), ("share", pa.float64())]),
    )
    sample = reliable(
        labelled.join(F.broadcast(shares), F.col("lang") == F.col("l"))
        .filter(F.pmod("place", F.lit(1_000_003)) < F.col("share") * 1_000_003)
        .select("lang", "text")
    )
    counted = (
        sample.mapInArrow(_count, "lang string, feature int, n bigint")
        .groupBy("lang", "feature")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    number = {x: i for i, x in enumerate(languages)}
    seen = np.zeros((len(languages), FEATURES))
    row = np.array([number[x] for x in counted.column("lang").to_pylist()], dtype=np.int64)
    seen[row, counted.column("feature").to_numpy()] = counted.column("n").to_numpy()
    seen += SMOOTHING
    share = seen / seen.sum(axis=1, keepdims=True)
    up, down = (code > 0).T.astype(float), (code < 0).T.astype(float)
    odds = np.log(up @ share / up.sum(axis=1, keepdims=True)) - np.log(
        down @ share / down.sum(axis=1, keepdims=True)
    )
    flat.weights = np.ascontiguousarray(odds.T, dtype=np.float32)
    return _calibrated(flat, sample)


def _calibrated(model: Model, sample: DataFrame) -> Model:
    """Scale the margins of each bit to 1 on average, and trust bits by their errors."""
    held, number = _share(sample, model), {x: i for i, x in enumerate(model.languages)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            size, wrong = np.zeros(m.code.shape[1]), np.zeros(m.code.shape[1])
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                found = margins(m, text.as_py().encode("utf-8", "surrogatepass"))
                size += abs(found)
                wrong += found * m.code[number[lang.as_py()]] <= 0
            yield pa.RecordBatch.from_pydict(
                {
                    "bit": np.arange(len(size), dtype=np.int32),
                    "size": size,
                    "wrong": wrong,
                    "n": np.full(len(size), batch.num_rows, dtype=np.int64),
                }
            )

    rows = (
        sample.mapInArrow(measure, "bit int, size double, wrong double, n bigint")
        .groupBy("bit")
        .agg(F.sum("size").alias("size"), F.sum("wrong").alias("wrong"), F.sum("n").alias("n"))
        .collect()
    )
    for r in rows:
        error = (r["wrong"] + 1) / (r["n"] + 2)
        model.scale[r["bit"]] = max(r["size"] / r["n"], 1e-6)
        model.trust[r["bit"]] = math.log((1 - min(error, 0.49)) / min(error, 0.49))
    model.trust /= model.trust.mean()
    return model


def _share(df: DataFrame, model: Model):
    """The model as a broadcast: features x bits, fixed by the number of languages."""
    return df.sparkSession.sparkContext.broadcast(model)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and lang_pred, score, ambiguous.

    A text that is null or without a letter is ``und`` with score 0, as is
    every text of a model without languages; a model of one language
    gives that one with score 1 otherwise. Repeated rows are predicted alike.
    Columns of the input that bear a name of the result are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "ambiguous")]
    # The text travels once: as the kept column, or else behind the others.
    sent = keep if text_col in keep else [*keep, text_col]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in sent],
        F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False)).alias("__letters"),
    )
    at, kept = sent.index(text_col), len(keep)
    held = _share(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in (whole.slice(low, _ROWS) for whole in batches for low in range(0, whole.num_rows, _ROWS)):
            langs, scores = [], []
            for text, lettered in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                if not lettered.as_py() or not m.languages:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = decode(m, margins(m, text.as_py().encode("utf-8", "surrogatepass")))
                langs.append(m.languages[int(p.argmax())])
                scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:kept],
                    pa.array(langs, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array([s < AMBIGUOUS for s in scores], pa.bool_()),
                ],
                names=[*batch.schema.names[:kept], "lang_pred", "score", "ambiguous"],
            )

    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:kept]]
        + ["lang_pred string", "score double", "ambiguous boolean"]
    )
    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for documents that training never sees; a null id is a training row."""
    return F.coalesce(fold_of(F.col(id_col), 4) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Train on the training fold of ``docs`` and predict every row."""
    model = train(docs.filter(~held_out()))
    return predict(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])


def keep_known(docs: DataFrame) -> DataFrame:
    """Pipeline stage: rows whose language is known; columns unchanged."""
    names = docs.columns
    model = train(docs.filter(~held_out()))
    return predict(docs, model).filter(
        (F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous")
    ).select(*[F.col(f"`{n}`") for n in names])
