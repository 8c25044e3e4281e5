"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed one-, two- and three-character grams of every
labelled text, whole, and adds the counts up by (language, bucket). The model
is a matrix of log-probabilities, buckets x languages, whose size depends on
the number of languages alone; it is broadcast. Scoring works on Arrow batches:
all texts of a batch become one array of code points, its grams one array of
buckets (a sparse matrix in row form, with the buckets of each text one after the
other), and its product with the broadcast matrix gives each text's log-likelihoods.

The score is the posterior of the predicted language times how typical the text
is of it: posteriors of long texts saturate, whatever they are written in. The
model knows the mean log-probability of its own grams; a text whose grams are
less likely than that by d nats a gram is exp(-d) typical, one whose grams are
as likely or more is 1. A text in a language that was never learned has a low
score, although some learned language must come nearest.

Defined results: a text that is null or has no letter is ``und`` with score 0;
so is every text if there is nothing to learn from. More languages than
``most_languages`` are an error, since the model would outgrow the driver. Rows with a null language
or a null text teach nothing. Equal texts get equal predictions; ties go to the
language that sorts first. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lernspur.llm.tokens import text_groups

UNKNOWN = "und"
#: Bytes of text that are worked on together.
AT_A_TIME = 1_000_000


@dataclass(frozen=True)
class LangConfig:
    #: log2 of the number of hash buckets
    bucket_bits: int = 15
    smoothing: float = 0.5
    max_chars: int = 3
    most_languages: int = 1000


@dataclass(frozen=True)
class LangModel:
    languages: list[str] = field(default_factory=list)
    #: (buckets, languages) float32 log-probabilities, and the log prior of each language
    weights: np.ndarray | None = None
    prior: np.ndarray | None = None


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row and the bounds of each text among them."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None else b""
    starts = (np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(starts)])
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
    return points, before[offsets - offsets[0]]


def gram_buckets(points: np.ndarray, bounds: np.ndarray, config: LangConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: the bucket at every place, and which places have a gram that stays inside its text."""
    shift = np.uint32(32 - config.bucket_bits)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    mixed = np.zeros(len(points), dtype=np.uint32)
    for n in range(1, config.max_chars + 1):
        mixed = mixed * np.uint32(0x9E3779B1)
        mixed[: max(0, len(points) - n + 1)] += points[n - 1 :] + np.uint32(1)
        bucket = ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)) >> shift
        yield bucket, np.arange(n, len(points) + n) <= ends


def train(labelled: DataFrame, config: LangConfig = LangConfig()) -> LangModel:
    """Learns from all rows of ``labelled`` (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                texts = batch.filter(pc.equal(langs, lang)).column("text")
                total = sums.setdefault(lang, np.zeros(1 << config.bucket_bits, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + len(texts)
                for a, b in text_groups(texts, AT_A_TIME):
                    for bucket, inside in gram_buckets(*code_points(texts.slice(a, b - a)), config):
                        total += np.bincount(bucket[inside], minlength=len(total))
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], docs[lang]))], names=["lang", "bucket", "n"]
            )

    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select(F.lower("text").alias("text"), "lang")
    counts = usable.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row more than the bound allows tells that it is passed
    found = counts.limit(config.most_languages * ((1 << config.bucket_bits) + 1) + 1).toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > config.most_languages:
        raise ValueError(f"more than {config.most_languages} languages to learn")
    if not languages:
        return LangModel()
    column = found["lang"].map({lang: i for i, lang in enumerate(languages)}).to_numpy()
    grams = (found["bucket"] >= 0).to_numpy()
    matrix = np.zeros((1 << config.bucket_bits, len(languages)))
    matrix[found["bucket"].to_numpy()[grams], column[grams]] = found["n"].to_numpy()[grams]
    docs = np.zeros(len(languages))
    docs[column[~grams]] = found["n"].to_numpy()[~grams]
    matrix += config.smoothing
    return LangModel(languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), np.log(docs / docs.sum()))


def log_likelihoods(points: np.ndarray, bounds: np.ndarray, model: LangModel, config: LangConfig) -> np.ndarray:
    """(texts, languages) sums of log-probabilities of their grams."""
    out = np.zeros((len(bounds) - 1, len(model.languages)))
    columns = [np.ascontiguousarray(model.weights[:, j]) for j in range(len(model.languages))]
    for bucket, inside in gram_buckets(points, bounds, config):
        for j, column in enumerate(columns):
            run = np.concatenate([[0.0], np.cumsum(np.where(inside, column[bucket], np.float32(0)), dtype=np.float64)])
            out[:, j] += run[bounds[1:]] - run[bounds[:-1]]
    return out


def own_means(model: LangModel) -> np.ndarray:
    """Mean log-probability of each language's grams under its own model (the negative entropy)."""
    weights = model.weights.astype(np.float64)
    return (np.exp(weights) * weights).sum(axis=0)


def judge(sums: np.ndarray, chars: np.ndarray, model: LangModel, usual: np.ndarray, config: LangConfig) -> tuple[np.ndarray, np.ndarray]:
    """The best language (the number of languages where a text is empty) and the score of each text."""
    likely = sums + model.prior
    best = likely.argmax(axis=1)
    odds = np.exp(likely - likely.max(axis=1, keepdims=True))
    grams = sum(np.maximum(chars - n, 0) for n in range(config.max_chars))
    typical = np.exp(np.minimum(0.0, sums[np.arange(len(best)), best] / np.maximum(grams, 1) - usual[best]))
    empty = chars == 0
    return np.where(empty, len(model.languages), best), np.where(empty, 0.0, odds.max(axis=1) / odds.sum(axis=1) * typical)


def predict(docs: DataFrame, model: LangModel, config: LangConfig = LangConfig(), row: str = "row") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (posterior of the predicted language times how typical the text is of it, 0 to 1) to rows with columns ``text`` and ``row``."""
    if not model.languages:
        return docs.drop("text").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.weights, model.prior))
    schema = docs.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = LangModel(*shared.value)
        names, usual = np.array([*known.languages, UNKNOWN]), own_means(known)
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in text_groups(whole.column("__letters"), AT_A_TIME)):
            points, bounds = code_points(batch.column("__letters"))
            sums = log_likelihoods(points, bounds, known, config)
            best, sure = judge(sums, np.diff(bounds), known, usual, config)
            rest = [batch.column(c) for c in batch.schema.names if c != "__letters"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names[best].tolist(), pa.string()), pa.array(sure)], names=schema.fieldNames())

    letters = F.when(F.col("text").rlike(r"\p{L}"), F.lower("text")).otherwise(F.lit(""))
    return docs.withColumn("__letters", letters).drop("text").mapInArrow(score, schema)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, config: LangConfig = LangConfig(), with_text: bool = True) -> DataFrame:
    """``row`` (all input columns, or all but the text), held_out, lang_pred and score; learns from the rows that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"), config)
    row = F.struct("*") if with_text else F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    scored = predict(docs.select(row.alias("row"), held_out(F.col("doc_id")).alias("held_out"), "text"), model, config)
    return scored


def keep_known(docs: DataFrame, min_score: float = 0.3, config: LangConfig = LangConfig()) -> DataFrame:
    """The documents whose language is known with a score of at least ``min_score``, with their own columns."""
    return identify(docs, config).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("row.*")
