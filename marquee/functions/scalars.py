"""Column expressions: cleaning, labelling and list columns. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_MARK = "\\N"

# Genre classes of the catalogue.
FICTION_GENRES = [
    "Drama", "Comedy", "Action", "Adventure", "Sci-Fi", "Fantasy", "Horror", "Thriller", "Romance", "Mystery",
    "Crime", "Animation", "Family", "Musical", "Western", "War", "Film-Noir", "Short", "Sport", "Biography", "History",
]
NONFICTION_GENRES = ["Documentary", "Reality-TV", "News", "Talk-Show", "Game-Show"]

# Lower bound of each generation by birth year, newest first.
GENERATIONS = [(2010, "Gen Alpha"), (1997, "Gen Z"), (1981, "Millennial"), (1965, "Gen X"), (1946, "Boomer")]
OLDEST_GENERATION = "Silent/Greatest"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def clean_nulls(df: DataFrame, marker: str = NULL_MARK, columns: Sequence[str] | None = None) -> DataFrame:
    """Null markers of the raw files become NULL."""
    columns = string_columns(df) if columns is None else columns
    return df.withColumns({c: F.nullif(F.col(c), F.lit(marker)) for c in columns})


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def to_flag(col: Column | str) -> Column:
    """'1' is true; everything else, null included, is false."""
    return F.coalesce(as_col(col) == F.lit("1"), F.lit(False))


def is_present(col: Column | str, marker: str = NULL_MARK) -> Column:
    """Neither null, nor empty, nor the null marker."""
    col = as_col(col)
    return F.coalesce((col != "") & (col != marker), F.lit(False))


def require(df: DataFrame, column: str, marker: str = NULL_MARK) -> tuple[DataFrame, DataFrame]:
    """Split into rows with the mandatory column and rows for quarantine."""
    present = is_present(column, marker)
    return df.filter(present), df.filter(~present)


def cast_columns(df: DataFrame, casts: Mapping[str, str]) -> DataFrame:
    """Typed columns; text that does not parse becomes NULL instead of failing the job."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})


# Upper bounds (exclusive) and names, from the top; without a bound: all above.
POPULARITY = [(10_000, "low"), (100_000, "medium"), (None, "high")]
RATING_BUCKETS = [(6, "average"), (8, "good"), (None, "excellent")]


def _bucket(value: Column, bounds, missing: str) -> Column:
    """The name of the first bound above the value."""
    named = [F.when(F.lit(True) if bound is None else value < bound, name) for bound, name in bounds]
    return F.when(value.isNull(), missing).otherwise(F.coalesce(*named))


def popularity_segment(votes: Column | str) -> Column:
    return _bucket(as_col(votes), POPULARITY, "unknown")


def rating_bucket(rating: Column | str) -> Column:
    return _bucket(as_col(rating), RATING_BUCKETS, "unrated")


def generation(birth_year: Column | str) -> Column:
    birth_year = as_col(birth_year)
    label = F.when(birth_year.isNull(), None)
    for first_year, name in GENERATIONS:
        label = label.when(birth_year >= first_year, name)
    return label.otherwise(OLDEST_GENERATION)


def age_at_death(birth_year: Column | str, death_year: Column | str) -> Column:
    return as_col(death_year) - as_col(birth_year)


def decade(year: Column | str) -> Column:
    """First year of the decade, rounding towards zero; years are positive here."""
    year = as_col(year)
    return (year - year % 10).cast("int")


def genre_class(genre: Column | str) -> Column:
    genre = as_col(genre)
    return F.when(genre.isin(FICTION_GENRES), "Fiction").when(genre.isin(NONFICTION_GENRES), "Non-fiction").otherwise("Other")


def title_class(genres: Column | str) -> Column:
    """Class of a genre array; one non-fiction genre decides."""
    genres = as_col(genres)
    return (
        F.when(F.arrays_overlap(genres, F.lit(NONFICTION_GENRES)), "Non-fiction")
        .when(F.arrays_overlap(genres, F.lit(FICTION_GENRES)), "Fiction")
        .otherwise("Other")
    )


def like_escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def ilike_contains(col: Column | str, text: str) -> Column:
    """Case-insensitive search in which ``%`` and ``_`` of the text mean themselves."""
    return as_col(col).ilike(f"%{like_escape(text)}%")


def matches(col: Column | str, pattern: str) -> Column:
    return as_col(col).rlike(pattern)


def split_list(col: Column | str, sep: str = ",") -> Column:
    """Separated text as an array of trimmed, non-empty items; NULL stays NULL."""
    literal = "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in sep)
    return F.filter(F.transform(F.split(as_col(col), literal), lambda i: F.trim(i)), lambda item: item != "")


def list_size(col: Column | str, sep: str = ",", null_as: int = 1) -> Column:
    """Number of separated items; a null list counts as ``null_as`` (one by default)."""
    col = as_col(col)
    return F.when(col.isNull(), F.lit(null_as)).otherwise(F.size(F.split(col, F.lit(sep))))


def has_item(col: Column | str, item: str) -> Column:
    """Whether a separated list holds the item; a null list does not."""
    return F.coalesce(F.array_contains(split_list(col), item), F.lit(False))


def clamp(col: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(as_col(col), F.lit(high)), F.lit(low))


def audit_defaults(df: DataFrame, batch: str = "batch_id", stamp: str = "ingested_at") -> DataFrame:
    """Rows from before lineage was kept get batch 'legacy' and the epoch."""
    return df.withColumns({
        batch: F.coalesce(F.col(batch), F.lit("legacy")),
        stamp: F.coalesce(F.col(stamp), F.lit("1970-01-01").cast(df.schema[stamp].dataType)),
    })


def attr_hash(columns: Sequence[str], escape: bool = False) -> Column:
    """MD5 over attribute values, null and empty alike.

    With ``escape`` a separator inside a value cannot make two different rows collide.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    if escape:
        parts = [F.replace(F.replace(p, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")) for p in parts]
    return F.md5(F.concat_ws("|", *parts))


def quadrant(x: Column, y: Column, x_mid: Column, y_mid: Column) -> Column:
    """Popularity against quality, split at the medians."""
    return (
        F.when((x > x_mid) & (y > y_mid), "Blockbuster Hits")
        .when(x > x_mid, "Popular Duds")
        .when(y > y_mid, "Hidden Gems")
        .otherwise("Obscure Failures")
    )


def weighted_rating(rating: Column, votes: Column, prior_rating: Column, prior_votes: Column) -> Column:
    """Bayesian mean: a title with few votes is pulled towards the catalogue mean."""
    total = votes + prior_votes
    return (votes * rating + prior_votes * prior_rating) / F.when(total != 0, total)


def career_length(first_year: Column | str, last_year: Column | str) -> Column:
    return as_col(last_year) - as_col(first_year)
