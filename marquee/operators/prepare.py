"""One fitted pipeline from raw columns to a feature vector, saved and loaded as a whole.

Numbers are filled with their exact median and standardised by the mean and population deviation of the filled values,
categories are one-hot (a null is the category "missing", an unseen one is all zeros), comma lists are multi-hot over the
train vocabulary, texts are the mean of their words' vectors. Everything is learned from the train rows alone and is kept
in the stages of a ``PipelineModel``, so a stored model scores raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.feature import CountVectorizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.features import assert_no_leakage
from marquee.operators.ordering import exact_quantiles
from marquee.operators.word_vectors import WordVectors
from marquee.session import scratch_path

MISSING = "missing"
MOST_WORDS = (1 << 31) - 1  # a vocabulary is never cut


@dataclass(frozen=True)
class Columns:
    """Which columns are features, and how. ``text_size`` is the length of a text's vector."""

    numeric: Sequence[str] = ()
    categorical: Sequence[str] = ()
    lists: Sequence[str] = ()
    texts: Sequence[str] = ()
    text_size: int = 16

    def all(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.lists, *self.texts]

    def without(self, names: Sequence[str]) -> Columns:
        kept = {kind: [c for c in getattr(self, kind) if c not in names] for kind in ("numeric", "categorical", "lists", "texts")}
        return replace(self, **kept)


def _number(column: str) -> Column:
    """A number, null where it is missing or no number."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def numeric_statistics(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, fill, mean, sd) per column: the exact median, then mean and population deviation of the filled values.

    A column without any number is filled with 0.
    """
    numbers = train.select(*[_number(c).alias(c) for c in columns])
    long = numbers.unpivot([], list(columns), "feature", "value")
    medians = exact_quantiles(long, "value", [0.5], ["feature"]).select("feature", F.col("q0").alias("median"))
    # Sums per column say what the filled values add up to, so the rows are read once more and not joined.
    sums = long.groupBy("feature").agg(
        F.count("*").alias("rows"), F.count("value").alias("n"), F.avg("value").alias("own_mean"), F.var_pop("value").alias("own_var")
    )
    joined = sums.join(medians, "feature", "left")
    fill = F.coalesce("median", F.lit(0.0))
    share = F.col("n") / F.col("rows")
    own, var = F.coalesce("own_mean", F.lit(0.0)), F.coalesce("own_var", F.lit(0.0))
    mean = share * own + (1 - share) * fill
    spread = share * (var + (own - mean) * (own - mean)) + (1 - share) * (fill - mean) * (fill - mean)
    return joined.select("feature", fill.alias("fill"), mean.alias("mean"), F.sqrt(spread).alias("sd"))


def _literal(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _select(expressions: dict[str, str]) -> SQLTransformer:
    made = ", ".join(f"{sql} AS `{name}`" for name, sql in expressions.items())
    return SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__")


def text_encoder(text: str, size: int, out: str, seed: int = 42, partitions: int = 1) -> list:
    """Unfitted stages: words of whole texts, and the mean of their fitted vectors. A null text is blank.

    The texts are learned from in ``partitions`` parts whose vectors are averaged, so more of them blur small corpora.
    """
    words = f"{text}_words"
    return [
        _select({f"{text}_filled": f"coalesce(CAST(`{text}` AS STRING), '')"}),
        RegexTokenizer(inputCol=f"{text}_filled", outputCol=words, pattern=r"[^\p{L}\p{N}]+"),
        WordVectors(words, out, size, seed, partitions),
    ]


def learning_parts(train: DataFrame) -> int:
    """As many parts as the session shuffles into."""
    return int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fit_text_encoder(train: DataFrame, text: str, size: int = 16, out: str = "embedding", seed: int = 42) -> PipelineModel:
    """The default text encoder: word vectors fitted on the train texts."""
    return Pipeline(stages=text_encoder(text, size, out, seed, learning_parts(train))).fit(train)


def vector_parts(columns: Columns) -> list[str]:
    """The columns that make up the vector, in its order. Each depends on its own raw column alone."""
    kinds = {"scaled": columns.numeric, "coded": columns.categorical, "hot": columns.lists, "vector": columns.texts}
    return [f"{c}_{kind}" for kind, names in kinds.items() for c in names]


def stages(train: DataFrame, columns: Columns, out: str = "features") -> list:
    """Stages of the preprocessor, numbers already fitted on ``train``; the last puts the vector together."""
    assert_no_leakage(columns.all())
    made = []
    if columns.numeric:
        stats = {r["feature"]: r for r in numeric_statistics(train, columns.numeric).collect()}  # a row per column
        scaled = {}
        for c in columns.numeric:
            fill, mean, sd = (stats[c][k] for k in ("fill", "mean", "sd")) if c in stats else (0.0, 0.0, 1.0)
            value = f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)), {_literal(fill)})"
            scaled[f"{c}_scaled"] = f"({value} - {_literal(mean)}) / {_literal(sd or 1.0)}"
        made.append(_select(scaled))
    if columns.categorical:
        filled, indexed, coded = ([f"{c}_{x}" for c in columns.categorical] for x in ("known", "index", "coded"))
        made.append(_select({f: f"coalesce(CAST(`{c}` AS STRING), '{MISSING}')" for f, c in zip(filled, columns.categorical)}))
        made.append(StringIndexer(inputCols=filled, outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"))
        # The indexer puts unseen values last, and the last of its categories is the one dropped.
        made.append(OneHotEncoder(inputCols=indexed, outputCols=coded, dropLast=True))
    for c in columns.lists:
        items = f"filter(transform(split(coalesce(`{c}`, ''), ','), x -> trim(x)), x -> x <> '')"
        made += [_select({f"{c}_items": items}), CountVectorizer(inputCol=f"{c}_items", outputCol=f"{c}_hot", binary=True, minDF=1, vocabSize=MOST_WORDS)]
    for c in columns.texts:
        made += text_encoder(c, columns.text_size, f"{c}_vector", partitions=learning_parts(train))
    return [*made, VectorAssembler(inputCols=vector_parts(columns), outputCol=out)]


def fit_preprocessor(train: DataFrame, columns: Columns, out: str = "features") -> PipelineModel:
    """The fitted pipeline from raw columns to the vector ``out``."""
    return Pipeline(stages=stages(train, columns, out)).fit(train)


def prepare(model: Model, df: DataFrame, out: str = "features") -> DataFrame:
    """``df`` with the vector, without the columns between."""
    return model.transform(df).select(*[F.col(f"`{c}`") for c in df.columns], out)


def chain(*models: Model) -> PipelineModel:
    """Fitted models one after the other, as one that can be stored."""
    return PipelineModel(stages=list(models))


def save(df: DataFrame, model: Model, label: str = "model") -> str:
    """Store a fitted pipeline in the shared folder; its path."""
    path = scratch_path(df.sparkSession, label)
    chain(model).write().save(path)
    return path


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
