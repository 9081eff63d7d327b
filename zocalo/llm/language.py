"""Language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zocalo.llm.frames import exact, id_remainder, numbered_columns, unit_hash
from zocalo.llm.grams import bucket_lists, histograms, sums_by_text

#: Buckets (as a power of two) and lengths of the character grams, taken from lower-cased text with blanks for ASCII non-letters.
BITS, ORDERS = 14, (1, 2, 3)
#: About how many documents with a known language the model is fitted on, and of each language at least, as far as there are.
TRAIN_ROWS, LANGUAGE_ROWS = 20_000, 500
#: Numbers in the broadcast matrix. Its buckets are halved until all languages fit, down to so many buckets (as a power of two).
MOST_NUMBERS, LEAST_BITS = 1 << 25, 6
UNKNOWN = "und"
#: A document is rejected where it has no letter, no language reaches this probability, or its grams are on average less likely
#: in its language than if all buckets were even.
LEAST_SCORE = 0.5

LETTER = re.compile(r"[^\W\d_]")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


@dataclass(frozen=True)
class Model:
    """Log-probabilities: buckets x languages, and one prior per language."""

    langs: list[str]
    grams: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its probability; ``und`` and 0 where the text is null or has no letter, or nothing was learned."""
        return self.judged(texts)[:2]

    def judged(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, its probability, and the mean log-likelihood of a gram in it over that of even buckets."""
        known = [t if t and LETTER.search(t) else "" for t in texts]
        if not self.langs or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        bits = len(self.grams).bit_length() - 1
        likely, size = sums_by_text(bucket_lists(known, ORDERS, bits, letters=True), len(known), self.grams)
        z = likely + self.prior
        best = z.argmax(1)
        sure = 1.0 / np.exp(z - z.max(1, keepdims=True)).sum(1)
        gain = likely[np.arange(len(best)), best] / np.maximum(size, 1) + bits * np.log(2)
        blank = np.array([not t for t in known], bool)
        return [UNKNOWN if no else self.langs[i] for no, i in zip(blank, best)], np.where(blank, 0.0, sure), np.where(blank, 0.0, gain)


def matrix_bits(langs: int) -> int:
    """Buckets (as a power of two) for so many languages. A column with too many values for the least matrix is no language column."""
    bits = min(BITS, (MOST_NUMBERS // max(langs, 1)).bit_length() - 1)
    if bits < LEAST_BITS:
        raise ValueError(f"{langs} different languages; at most {MOST_NUMBERS >> LEAST_BITS} fit the model")
    return bits


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS, language_rows: int = LANGUAGE_ROWS) -> Model:
    """Learns from about ``train_rows`` documents outside the held-out part whose language is not null.

    The sample is every such id whose hash falls below a threshold, which is higher for a language that would have fewer than
    about ``language_rows``; priors are by the counts of all. Tasks add up their own counts; Spark adds up the
    rest, and the driver gets languages x buckets numbers.
    """
    rows = exact(docs, doc_id="doc_id", text="text", lang="lang").where(F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), 5) != 0))
    many = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    bits = matrix_bits(len(many))
    share = train_rows / max(sum(many.values()), 1)
    shares = docs.sparkSession.createDataFrame([(lang, max(share, language_rows / n)) for lang, n in many.items()], "lang string, share double")
    sample = rows.join(F.broadcast(shares) if len(many) <= 1 << 12 else shares, "lang").where(unit_hash(F.coalesce("doc_id", F.lit(0)), seed=8) < F.col("share")).select("lang", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            lines = (line for x in histograms((t.as_py() for t in b.column(1)), ORDERS, bits, letters=True) for line in x)
            for lang, line in zip(b.column(0).to_pylist(), lines):
                sums[lang] = sums.get(lang, 0) + line.astype(np.int64)
        for lang, counts in sums.items():
            at = np.append(np.flatnonzero(counts), -1)  # bucket -1 says that the language was seen
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(np.append(counts[at[:-1]], 1), pa.int64())], names=["lang", "bucket", "n"])

    sums = (sample.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    counts, docs_of = np.zeros((1 << bits, len(langs))), np.array([many[x] for x in langs], float)
    place = {lang: i for i, lang in enumerate(langs)}
    col = np.array([place[x] for x in sums.column("lang").to_pylist()], int)
    at, n = np.asarray(sums.column("bucket"), int), np.asarray(sums.column("n"), float)
    gram = at >= 0
    counts[at[gram], col[gram]] = n[gram]
    smooth = counts + 0.5
    return Model(langs, np.log(smooth / smooth.sum(0)).astype(np.float32) if langs else smooth.astype(np.float32),
                 np.log(docs_of / max(docs_of.sum(), 1)))


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Only the text goes into a prediction.

    Null text and text without a letter give ``und`` with score 0, as does a table with nothing to learn from; repeated
    rows are judged each; an empty table gives an empty result; other columns are ignored. The broadcast matrix has
    a column for each language and 2**14 rows, or fewer where that would be more than 2**25 numbers.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, train_rows))
    rows = exact(docs, doc_id="doc_id", text="text")
    rows = rows.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sure = model.value.predict([t.as_py() for t in b.column(2)])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(langs, pa.string()),
                                              pa.array(sure, pa.float64())], schema=ARROW)

    return rows.mapInArrow(run, SCHEMA)


def known_language(docs: DataFrame, least: float = LEAST_SCORE, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents with a language of probability ``least`` or more that explains their grams better than even buckets; all columns.

    Null texts and texts without a letter go, as do all if there is nothing to learn from; of equal probabilities the first language by
    name counts; repeated rows are judged each; an empty table stays empty; columns whose names clash are kept as they are.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, train_rows))
    flat, at = numbered_columns(docs)

    @F.pandas_udf("boolean")
    def accepted(texts: pd.Series) -> pd.Series:
        langs, sure, gain = model.value.judged([t if isinstance(t, str) else None for t in texts])
        return pd.Series([lang != UNKNOWN and s >= least and g > 0 for lang, s, g in zip(langs, sure, gain)], dtype=bool)

    return flat.where(accepted(F.col(at["text"]))).toDF(*docs.columns)
