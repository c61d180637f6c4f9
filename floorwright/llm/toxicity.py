"""Toxicity by compression distance: two trained zstandard dictionaries, compared on the length of every window of a text.

Both dictionaries are trained by zstandard: one on windows of ordinary texts, one on the passages of toxic texts that
stand in significantly more of these than of ordinary texts (found by counting byte n-grams once for each text). A window
is a run of `words` words, windows tile the whole text. Each is first compressed with the toxic dictionary alone, fast; one
that this hardly shortens has nothing of it. The others are compressed twice more, as short as the coder can, with the ordinary
dictionary and with the toxic one put before it, so that ordinary material costs the same both times and only what toxic
texts brought makes a difference. Every byte of a window is spelled as three, so that a match of a few letters is long
enough for the coder.

A window falls in a cell (length with the ordinary dictionary, bytes saved by the toxic one); the cells' log odds come
from labelled texts that the dictionaries haven't seen, and so do the weights that make one score of a text's windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorwright.llm.common import bounded, give_back, in_one_task, keeps, lean, small, tidy, turns_to

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_TRIPLES = np.array([[b, b ^ 0x55, (b * 7 + 3) & 255] for b in range(256)], np.uint8)
#: Optimal parsing: the lengths of greedy and lazy parsing are too uneven to compare.
_SHORTEST = {"source_size": 256, "dict_size": 40 << 10, "strategy": zstandard.STRATEGY_BTOPT, "min_match": 5, "search_log": 3, "target_length": 16}
#: Fast, and only matches of more than two letters count.
_HINT = {"level": 1, "source_size": 256, "strategy": zstandard.STRATEGY_FAST, "min_match": 7, "target_length": 1}
#: A cell is ten bytes of length by one byte of saving.
_LENGTHS, _SAVED, _LOST = 10, 40, 8
#: The cell of windows that the toxic dictionary alone shortens by less than _GAIN bytes, in the fast pass.
_NOTHING, _GAIN = _LENGTHS * _SAVED, 8
#: So many windows' worth of the one-dimensional odds go into a cell's own.
_LEAN = 2000
#: Numbers of byte n-grams.
_GRAMS = 1 << 23
#: Windows spelled at once.
_CALL = 4096


@dataclass(frozen=True)
class ToxicityConfig:
    words: int = 3
    toxic_bytes: int = 8 << 10
    ordinary_bytes: int = 32 << 10
    #: Length of the byte n-grams that find the passages of toxic texts, and how many deviations and times more often than expected these are.
    gram: int = 5
    deviations: float = 7.0
    ratio: float = 3.0
    segment: int = 24
    #: Bytes of ordinary windows (chosen evenly) that the ordinary dictionary is trained on at most.
    training_bytes: int = 4 << 20
    #: Whether windows that the toxic dictionary alone, in the fast pass, hardly shortens skip the two slow ones.
    hint: bool = True
    #: Labelled rows that the fit uses at most (chosen by a hash); their texts are used whole.
    labelled_rows: int = 12_000
    #: Remainder of crc32(doc_id as text) modulo folds that is held out.
    folds: int = 5
    held_out: int = 0


@dataclass
class ToxicityModel:
    config: ToxicityConfig
    ordinary: bytes = b""
    toxic: bytes = b""
    prior: float = 0.0
    odds: np.ndarray = field(default_factory=lambda: np.zeros(_NOTHING + 1))
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None

    def key(self) -> int:
        return zlib.crc32(self.ordinary + self.toxic) ^ self.config.words


_ready: dict[int, tuple] = {}


def windows(text: bytes, words: int) -> list[bytes]:
    """The whole text as windows of so many words (the last may have fewer), A-Z lower-cased; without words none."""
    own = text.translate(_LOWER).split()
    return [b" " + b" ".join(own[i : i + words]) + b" " for i in range(0, len(own), words)]


def _spelled(found: list[bytes]) -> list[bytes]:
    """Each window with every byte as three."""
    whole = _TRIPLES[np.frombuffer(b"".join(found), np.uint8)].tobytes()
    ends = (3 * np.cumsum([len(w) for w in found])).tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _compressor(content: bytes, **more):
    how = zstandard.ZstdCompressionParameters.from_level(more.pop("level", 19), write_content_size=False, write_dict_id=False, write_checksum=False, **more)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(compression_params=how, dict_data=held).compress


def cells(model: ToxicityModel, text: bytes) -> np.ndarray:
    """The cell of each window of a text."""
    if model.key() not in _ready:
        keeps(__name__, _ready.clear)
        _ready.clear()
        _ready[model.key()] = (_compressor(model.toxic, **_HINT, dict_size=len(model.toxic)), _compressor(model.ordinary, **_SHORTEST), _compressor(model.toxic + model.ordinary, **_SHORTEST))
    fast, plain, toxic = _ready[model.key()]
    found = windows(text, model.config.words)
    out = np.full(len(found), _NOTHING, np.int16)
    for i in range(0, len(found), _CALL):
        for k, w in enumerate(_spelled(found[i : i + _CALL]), i):
            if not model.config.hint or len(w) - len(fast(w)) >= _GAIN:
                a = len(plain(w))
                out[k] = min(a // 10, _LENGTHS - 1) * _SAVED + min(max(a - len(toxic(w)) + _LOST, 0), _SAVED - 1)
    return out


def _features(odds: np.ndarray) -> list[float]:
    top = np.zeros(3)
    o = np.maximum(odds, 0)
    k = min(3, len(o))
    if k:
        top[:k] = np.sort(np.partition(o, len(o) - k)[len(o) - k :])[::-1]
    n = int((o > 1.5).sum())
    return [*top, np.log1p(n), np.log1p(n) - np.log(len(o) + 10), np.log(len(o) + 10)]


def _grams(text: bytes, n: int) -> np.ndarray:
    """A number below _GRAMS for each byte n-gram of the text; 0 for one that goes beyond a word's end."""
    x = np.frombuffer(text, np.uint8).astype(np.uint64)
    h = np.zeros(max(0, len(x) - n + 1), np.uint64)
    for j in range(n):
        h = h * np.uint64(0x100000001B3) + x[j : j + len(h)]
    h ^= h >> np.uint64(29)
    blank = np.concatenate([[0], np.cumsum(x == 32)])
    inside = blank[n : n + len(h)] - blank[1 : 1 + len(h)] == 0
    return np.where(inside, h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(41), np.uint64(0)).astype(np.int32)


def _line(text: bytes) -> bytes:
    return b" " + b" ".join(text.translate(_LOWER).split()) + b" "


def _passages(texts: list[tuple[bytes, int]], config: ToxicityConfig) -> list[bytes]:
    """The runs of toxic texts whose n-grams stand in significantly more toxic texts than expected."""
    counts, n = np.zeros((2, _GRAMS), np.int32), [0, 0]
    for t, y in texts:
        counts[y][np.unique(_grams(_line(t), config.gram))] += 1
        n[y] += 1
    counts[:, 0] = 0
    own = np.empty(_GRAMS, bool)
    for i in range(0, _GRAMS, 1 << 18):  # in parts, so that no more than the counts is held
        good, bad = counts[:, i : i + (1 << 18)].astype(np.float64)
        expected = (good + bad + 1) * (n[1] / max(1, sum(n)))
        own[i : i + len(bad)] = (bad - expected > config.deviations * np.sqrt(expected)) & (bad * n[0] > config.ratio * n[1] * (good + 0.5))
    del counts
    out = []
    for t, y in texts:
        if y:
            line = _line(t)
            hit = np.flatnonzero(own[_grams(line, config.gram)])
            for run in np.split(hit, np.flatnonzero(np.diff(hit) > config.gram) + 1) if len(hit) else []:
                out.append(line[run[0] : run[-1] + config.gram])
    return out


def _trained(size: int, samples: list[bytes], config: ToxicityConfig) -> bytes:
    """A dictionary that zstandard trains on the samples; too few of them to train on are the dictionary themselves."""
    try:
        return zstandard.train_dictionary(size, samples, k=config.segment, d=6, level=19).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples) or b"\0" * 9)[-size:]


def train_dictionaries(labelled: list[tuple[bytes, int]], config: ToxicityConfig) -> ToxicityModel:
    """A model with dictionaries and no weights yet. Texts that repeat count once; with one class only there are none."""
    own = sorted(dict(labelled).items(), key=lambda x: (zlib.crc32(x[0]), x[0]))
    model = ToxicityModel(config, prior=float(np.mean([y for _, y in own])) if own else 0.0)
    if len({y for _, y in own}) < 2:
        return model
    size = sum(3 * len(t) for t, y in own if not y)
    keep = max(1, -(-size // config.training_bytes))
    good = [w for t, y in own if not y for w in windows(t, config.words) if zlib.crc32(w) % keep == 0]
    model.ordinary = _trained(config.ordinary_bytes, _spelled(good), config)
    model.toxic = _trained(config.toxic_bytes, _spelled(_passages(own, config)), config)
    return model


def calibrate(model: ToxicityModel, found: list[tuple[np.ndarray, int]]) -> ToxicityModel:
    """Log odds of the cells and weights of a text's features, from (cells, label) of texts the dictionaries haven't seen."""
    y = np.array([v for _, v in found])
    if not model.toxic or len(set(y.tolist())) < 2:
        return model
    side = _NOTHING + 1
    hist = [sum((np.bincount(c, minlength=side) for c, v in found if v == k), np.zeros(side)) for k in (0, 1)]
    # a cell of few windows leans on all windows with the same saving
    saving = np.append(np.arange(_NOTHING) % _SAVED, _SAVED)
    alike = lambda h: np.bincount(saving, weights=h)[saving]
    both = hist[0] + hist[1]
    dealt = both / np.maximum(1, alike(both))  # how a saving's windows are dealt over lengths
    share = [(h + _LEAN * (alike(h) + 0.5 * h.sum() / both.sum()) / h.sum() * dealt) / (h.sum() + _LEAN) for h in hist]
    model.odds = np.where(both * alike(both) < 3, 0.0, np.log(np.maximum(share[1], 1e-12)) - np.log(np.maximum(share[0], 1e-12)))
    x = np.array([_features(model.odds[c]) for c, _ in found])
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - model.centre) / model.scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(60):  # Newton steps of a ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z.T * (p * (1 - p))) @ z + 0.1 * np.eye(len(w)), z.T @ (y - p) - 0.1 * w)
    model.weights = w
    return model


def scores(model: ToxicityModel, texts: list[bytes]) -> np.ndarray:
    """For each whole text the probability that its label is 1."""
    if model.weights is None:
        return np.full(len(texts), model.prior)
    x = np.array([_features(model.odds[cells(model, t)]) for t in texts]).reshape(-1, 6)
    z = np.c_[(x - model.centre) / model.scale, np.ones(len(x))] @ model.weights
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def held_out(doc_id: str, config: ToxicityConfig):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % config.folds == config.held_out


def fit_from_tables(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fits on labelled rows that aren't held out, at most config.labelled_rows of them, chosen by a hash of doc_id and text.

    Two thirds of the texts train the dictionaries, the rest calibrates. Where a doc_id has several labels the largest
    counts; rows that repeat a doc_id with its text count once. Null and empty texts and unlabelled rows are passed over.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").where(~held_out("doc_id", config))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = small(known, known.count())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).where("octet_length(text) > 0")
    rows = bounded(texts.join(known, "doc_id"), F.xxhash64("doc_id", "text"), config.labelled_rows).select("text", (F.col("toxic") > 0).cast("int").alias("toxic"))
    calibrates = F.crc32("text") % 3 == 2

    model = in_one_task(rows.where(~calibrates), lambda t, y: train_dictionaries(list(zip(t, y, strict=True)), config)) or ToxicityModel(config)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [cells(model, t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), b.column("toxic")], ["cells", "toxic"])

    if not model.toxic:
        return model
    # the join leaves few partitions; compressing is the work
    spread = rows.where(calibrates).repartition(64).mapInArrow(tidy(count), "cells binary, toxic int")
    ready = in_one_task(spread, lambda c, y: calibrate(model, sorted(((np.frombuffer(x, np.int16), v) for x, v in zip(c, y, strict=True)), key=lambda x: (x[1], x[0].tobytes()))))
    return ready or model


def score_documents(docs: DataFrame, model: ToxicityModel, column: str = "toxic_score") -> DataFrame:
    """docs with a column of scores added (one of that name is replaced). Null and empty texts count as texts without windows."""

    @F.arrow_udf("double")  # only texts go to the workers and only scores come back
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        turns_to(__name__)
        try:
            for texts in batches:
                yield pa.array(scores(model, [x or b"" for x in texts.cast(pa.binary()).to_pylist()]), pa.float64())
        finally:
            give_back()

    lean(docs.sparkSession)
    return docs.withColumn(column, score(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; a null doc_id counts as not held out.

    Without any labelled text of one class every score is the share of label 1 (0 without labels).
    """
    model = fit_from_tables(docs, labels, config)
    out = score_documents(docs.select("doc_id", "text"), model)
    held = F.coalesce(held_out("doc_id", config), F.lit(False))
    return out.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def fit(labelled: list[tuple[bytes, int]], config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """The same fit without tables: a model from a bounded list of (whole text, 0 or 1)."""
    part = lambda last: [(t, y) for t, y in labelled if t and (zlib.crc32(t) % 3 == 2) == last]
    model = train_dictionaries(part(False), config)
    return calibrate(model, [(cells(model, t), y) for t, y in part(True)]) if model.toxic else model


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
