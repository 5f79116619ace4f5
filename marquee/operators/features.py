"""Feature engineering on the marts."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.scalars import list_size, split_list
from marquee.operators.aggregates import histograms, pivot_roles
from marquee.operators.joins import join_unique
from marquee.operators.ordering import HOT_ROWS, dense_index
from marquee.operators.windows import explode_run, yearly_credits

# Fixed values of the feature contract.
FEATURE_TYPES = ["movie", "tvSeries", "tvMiniSeries", "tvMovie", "short"]
CREW_CATEGORIES = [
    "actor", "actress", "director", "writer", "producer", "composer", "editor", "cinematographer", "self",
    "archive_footage", "archive_sound",
]
# Columns that carry a target, the title's own rating averaged into its genre and year included.
TARGET_COLUMNS = ["average_rating", "num_votes", "rating_bucket", "popularity_segment", "avg_rating_genre_year", "avg_votes_genre_year"]
TRAIN_UNTIL, VAL_UNTIL = 2014, 2018


def dated_credits(performance: DataFrame, titles: DataFrame, roles: Sequence[str]) -> DataFrame:
    """(tconst, nconst, category, start_year) of credits in the roles on titles with a year."""
    dated = titles.filter("start_year IS NOT NULL").select("tconst", "start_year")
    return performance.filter(F.col("category").isin(list(roles))).select("tconst", "nconst", "category").join(dated, "tconst")


def exploded_genres(titles: DataFrame) -> DataFrame:
    return titles.select("tconst", "start_year", "average_rating", "num_votes", F.explode(split_list("genre_list")).alias("genre"))


def title_keys(titles: DataFrame, types: Sequence[str] = FEATURE_TYPES) -> DataFrame:
    return titles.filter(F.col("title_type").isin(list(types)) & F.col("start_year").isNotNull()).select("tconst")


def episode_stats(episodes: DataFrame, titles: DataFrame, keys: DataFrame, until: int = VAL_UNTIL) -> DataFrame:
    """Per series: rated episodes up to a year, so that later ratings do not leak into features."""
    rated = titles.filter(F.col("average_rating").isNotNull() & (F.col("start_year") <= until))
    rated = rated.select(F.col("tconst").alias("episode_key"), "average_rating")
    series = keys.withColumnRenamed("tconst", "series_key")
    known = episodes.select("series_key", "episode_key", "season_number").join(series, "series_key", "left_semi")
    return known.join(rated, "episode_key").groupBy(F.col("series_key").alias("tconst")).agg(
        F.count("*").alias("series_episode_count"),
        F.avg("average_rating").alias("series_avg_episode_rating"),
        F.min("season_number").alias("min_season"),
        F.max("season_number").alias("max_season"),
    )


def base_features(titles: DataFrame, performance: DataFrame, episodes: DataFrame, until: int = VAL_UNTIL) -> DataFrame:
    """One row per modelled title: attributes, crew counts, episode statistics."""
    modelled = titles.filter(F.col("title_type").isin(FEATURE_TYPES) & F.col("start_year").isNotNull())
    keys = modelled.select("tconst")
    credits = performance.select("tconst", "nconst", "category").join(keys, "tconst", "left_semi")
    counted = [F.count(F.when(F.col("category") == c, 1)).alias(f"{c}_count") for c in CREW_CATEGORIES]
    people = credits.groupBy("tconst").agg(
        F.count("*").alias("num_persons"), F.count_distinct("nconst").alias("unique_persons"), *counted
    )
    counts = ["num_persons", "unique_persons", *[f"{c}_count" for c in CREW_CATEGORIES], "series_episode_count"]
    return (
        modelled.select(
            "tconst", "title_type", "primary_title", F.col("is_adult").cast("int").alias("is_adult"), "start_year", "end_year",
            "runtime_minutes", "genre_list", "average_rating", "num_votes", "region_list", "language_list", "aka_count",
            "popularity_segment", "rating_bucket", list_size("genre_list").alias("genre_cnt"),
        )
        .join(people, "tconst", "left")
        .join(episode_stats(episodes, titles, keys, until), "tconst", "left")
        .fillna(0, counts)
    )


def genre_year_stats(titles: DataFrame) -> DataFrame:
    """Mean rating, mean votes and titles per genre and year over the modelled, rated titles."""
    rated = exploded_genres(titles.join(title_keys(titles), "tconst", "left_semi")).filter("average_rating IS NOT NULL")
    return rated.groupBy("genre", "start_year").agg(
        F.avg("average_rating").alias("avg_rating_genre_year"),
        F.avg("num_votes").alias("avg_votes_genre_year"),
        F.count("*").alias("genre_year_title_count"),
    )


def _modelled_credits(performance: DataFrame, titles: DataFrame, roles: Sequence[str]) -> DataFrame:
    modelled = titles.filter(F.col("title_type").isin(FEATURE_TYPES))
    return dated_credits(performance, modelled, roles)


def person_year_stats(performance: DataFrame, titles: DataFrame, roles: Sequence[str] = ("director", "writer")) -> DataFrame:
    """Career state of each person and role per active year, one row per running credit number."""
    years = yearly_credits(_modelled_credits(performance, titles, roles), ["nconst", "category"], "start_year")
    runs = explode_run(years, ["nconst", "category", "start_year"], "credits", "_i")
    return runs.select(
        "nconst", "category", "start_year", "debut_year", (F.col("start_year") - F.col("debut_year")).alias("career_length"),
        (F.col("credits_before") + F.col("_i")).alias("cumulative_credits"), F.col("recent_credits").alias("recent_5yr_credits"),
    )


def crew_features(
    performance: DataFrame, titles: DataFrame, roles: Mapping[str, str] = {"director": "dir", "writer": "wri"}
) -> DataFrame:
    """Career features of a title's directors and writers at its release.

    A person-year with c credits stands for c running numbers, so averages are weighted by c. Sums replace
    the c rows per credit that the join to :func:`person_year_stats` would create.
    """
    credits = _modelled_credits(performance, titles, list(roles))
    years = yearly_credits(credits, ["nconst", "category"], "start_year")
    c = F.col("credits")
    state = years.select(
        "nconst", "category", "start_year", "credits", (F.col("start_year") - F.col("debut_year")).alias("length"),
        (c * F.col("credits_before") + c * (c + 1) / 2).alias("running"), "recent_credits",
    )
    joined = join_unique(credits, state, ["nconst", "category", "start_year"], hot=c > HOT_ROWS)
    rows = F.sum("credits")
    stats = joined.groupBy("tconst", "category").agg(
        (F.sum(F.col("length") * c) / rows).alias("avg_career_len"),
        F.max("length").alias("max_career_len"),
        (F.sum("running") / rows).alias("avg_experience"),
        (F.sum(F.col("recent_credits") * c) / rows).alias("avg_recent_activity"),
    )
    measures = ["avg_career_len", "max_career_len", "avg_experience", "avg_recent_activity"]
    return pivot_roles(stats, "tconst", "category", roles, {m: m for m in measures})


def temporal_features(titles: DataFrame, performance: DataFrame) -> DataFrame:
    """Crew careers and genre-year climate of each modelled title."""
    modelled = titles.join(title_keys(titles), "tconst", "left_semi")
    climate = exploded_genres(modelled).select("tconst", "genre", "start_year").join(
        genre_year_stats(titles), ["genre", "start_year"], "left"
    )
    per_title = climate.groupBy("tconst").agg(
        F.avg("avg_rating_genre_year").alias("avg_rating_genre_year"),
        F.avg("avg_votes_genre_year").alias("avg_votes_genre_year"),
        F.max("genre_year_title_count").alias("genre_year_title_count"),
    )
    return modelled.select("tconst").join(crew_features(performance, titles), "tconst", "left").join(per_title, "tconst", "left")


def temporal_split(year: Column | str, train_until: int = TRAIN_UNTIL, val_until: int = VAL_UNTIL) -> Column:
    """Split label by year; NULL without a year."""
    year = F.col(year) if isinstance(year, str) else year
    return F.when(year <= train_until, "train").when(year <= val_until, "val").when(year > val_until, "test")


def safe_minmax(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None, suffix: str = "_scaled") -> DataFrame:
    """Min-max scaling by the bounds of the fitting rows (all rows by default); a zero range divides by one."""
    source = df if fit_on is None else df.filter(fit_on)
    bounds = source.agg(F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns]).alias("b"))
    b = F.col("_bounds")
    scaled = {}
    for c in columns:
        low, span = b[c]["lo"], b[c]["hi"] - b[c]["lo"]
        scaled[f"{c}{suffix}"] = (F.col(c) - low) / F.when(span == 0, F.lit(1)).otherwise(span)
    return df.withColumn("_bounds", bounds.scalar()).withColumns(scaled).drop("_bounds")


def assert_no_leakage(columns: Sequence[str], targets: Sequence[str] = TARGET_COLUMNS) -> list[str]:
    """The columns unchanged, or an error naming those that carry the target."""
    leaked = sorted(set(columns) & set(targets))
    if leaked:
        raise ValueError(f"target columns among the features: {leaked}")
    return list(columns)


def assemble(df: DataFrame, columns: Sequence[str], embeddings: DataFrame, key: str, embedding: str, out: str = "features") -> DataFrame:
    """Numeric columns and an embedding array as one vector, matched by key; a missing number becomes NaN."""
    from pyspark.ml.functions import array_to_vector

    assert_no_leakage(columns)
    joined = df.join(embeddings.select(key, F.col(embedding).alias("_embedding")), key)
    numbers = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns])
    whole = F.concat(numbers, F.col("_embedding").cast("array<double>"))
    return joined.withColumn(out, array_to_vector(whole)).drop("_embedding")


def embed_text(df: DataFrame, key: str, text: str, encoder, batch: int = 128, out: str = "embedding") -> DataFrame:
    """Embed whole texts with a caller's encoder: a picklable function from a list of texts to rows of floats.

    Null texts are embedded as blanks. Batches go through Arrow; partitions come from the input.
    """
    key_type = df.schema[key].dataType.simpleString()

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            rows = []
            for start in range(0, len(texts), batch):
                rows.extend([[float(x) for x in row] for row in encoder(texts[start : start + batch])])
            yield pd.DataFrame({key: frame[key], out: rows})

    return df.select(key, text).mapInPandas(encode, f"{key} {key_type}, {out} array<float>")


def hashed_text_vectors(df: DataFrame, text: str, dims: int = 64, out: str = "embedding") -> DataFrame:
    """Term-frequency vectors of whole texts without a model: hashed words, in the JVM."""
    from pyspark.ml.feature import HashingTF, RegexTokenizer

    filled = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    words = RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+").transform(filled)
    return HashingTF(inputCol="_words", outputCol=out, numFeatures=dims).transform(words).drop("_words")


def interactions(
    performance: DataFrame, titles: DataFrame, roles: Sequence[str] = ("actor", "actress", "director")
) -> DataFrame:
    """(user_id, item_id, rating, year) of credits on rated, dated titles."""
    rated = titles.filter("average_rating IS NOT NULL AND start_year IS NOT NULL")
    rated = rated.select("tconst", F.col("average_rating").alias("rating"), F.col("start_year").alias("year"))
    credits = performance.filter(F.col("category").isin(list(roles))).select("tconst", F.col("nconst").alias("user_id"))
    return credits.join(rated, "tconst").select("user_id", F.col("tconst").alias("item_id"), "rating", "year")


def index_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """(id, dense 0-based index), in id order."""
    return dense_index(df, column, name).select(column, name)


def with_indexes(inter: DataFrame) -> DataFrame:
    """Interactions with ``user_idx`` and ``item_idx``."""
    out = inter
    for column, name in (("user_id", "user_idx"), ("item_id", "item_idx")):
        index = dense_index(inter, column, name, count="_rows")
        out = join_unique(out, index, [column], hot=F.col("_rows") > HOT_ROWS).drop("_rows")
    return out


def interaction_summary(inter: DataFrame) -> DataFrame:
    return inter.agg(
        F.count_distinct("user_id").alias("num_users"), F.count_distinct("item_id").alias("num_items"), F.count("*").alias("num_rows")
    )


def user_profiles(inter: DataFrame, embeddings: DataFrame, threshold: float = 7.0, item: str = "item_id") -> DataFrame:
    """(user_id, profile): mean embedding of the items a user rated at least ``threshold``.

    Other users get the mean over all items. Vectors are averaged by a partial aggregate in the JVM.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    vectors = embeddings.select(F.col(item), array_to_vector("embedding").alias("_v"))
    overall = vectors.agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("m")).scalar()
    liked = inter.filter(F.col("rating") >= threshold).join(vectors, item)
    means = liked.groupBy("user_id").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("_mean"))
    users = inter.select("user_id").distinct()
    return users.join(means, "user_id", "left").select("user_id", F.coalesce("_mean", overall).alias("profile"))


def feature_statistics(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Baseline histograms, with the number of values of each feature."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("count")) for c in columns])
    long = counts.select(F.explode(entries).alias("_e")).select("_e.*")
    return histograms(df, columns, bins).join(long, "feature")


def drift(baseline: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """KL divergence of each feature's histogram from its baseline, and whether it exceeds the threshold."""
    b = baseline.select("feature", "bin", F.col("prob").alias("p"))
    c = current.select("feature", "bin", F.col("prob").alias("q"))
    total = F.sum(F.col("p") * F.log(F.col("p") / F.col("q")))
    return b.join(c, ["feature", "bin"]).groupBy("feature").agg(total.alias("kl")).withColumn("drifted", F.col("kl") > threshold)


def add_noise(df: DataFrame, columns: Sequence[str], level: float, seed: int) -> DataFrame:
    """Gaussian noise of ``level`` standard deviations on each column."""
    spread = df.agg(F.struct(*[F.stddev_pop(c).alias(c) for c in columns]).alias("s")).scalar()
    noise = {c: F.col(c) + F.randn(seed + i) * level * F.col("_spread")[c] for i, c in enumerate(columns)}
    return df.withColumn("_spread", spread).withColumns(noise).drop("_spread")
