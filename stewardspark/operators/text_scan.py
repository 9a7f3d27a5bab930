"""Personal data and secrets in texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stewardspark import fixed_values as fv


def pii_secret_scan(
    documents: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    patterns: dict[str, str] | None = None,
) -> DataFrame:
    """One row per document and kind that occurs in it, with the number of hits.

    Whole texts are scanned, without a shuffle; a document leaves behind counts
    only. ``patterns`` replaces the usual kinds.
    """
    marks = {} if patterns else fv.TEXT_MARKS
    patterns = patterns or fv.TEXT_PATTERNS
    text = F.col(text_column)

    def hits(kind: str) -> Column:
        count = F.regexp_count(text, F.lit(patterns[kind]))
        if kind in marks:
            return F.when(F.contains(text, F.lit(marks[kind])), count).otherwise(0)
        return count

    found = F.array(
        *[F.struct(F.lit(kind).alias("kind"), hits(kind).alias("hits")) for kind in patterns]
    )
    return documents.select(id_column, F.inline(found)).filter(F.col("hits") > 0)


def words_of(text: Column) -> Column:
    """Letters and digits between other characters, in lower case; an apostrophe or hyphen may join them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)*)"), F.lit(1))


def dictionary_scan(
    documents: DataFrame,
    phrases: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document and kind of ``phrases`` (kind, phrase) that occurs in it, with the number of hits.

    A phrase is one or more words and occurs where the same words follow each other,
    whatever the case and what stands between them; a phrase that is written twice
    under a kind counts once. Names and places are such phrases, of which no pattern
    tells. Null texts and phrases without a word have no hits.

    All phrases are looked up at once: each place of a text that begins with the first
    word of a phrase meets the phrases with that word by a join, with as many words as
    the longest has. A frequent word is split by adaptive execution; hits are counted in
    each task before they move.
    """
    listed = phrases.select("kind", words_of(F.col("phrase")).alias("words")).filter(F.size("words") > 0)
    listed = listed.distinct().select(
        "kind", F.col("words")[0].alias("first"), F.array_join("words", " ").alias("phrase"),
        F.size("words").alias("length"),
    )
    longest = listed.agg(F.coalesce(F.max("length"), F.lit(1))).scalar()
    words = documents.select(id_column, words_of(F.col(text_column)).alias("words"), longest.alias("most"))
    # A window holds the words from a place on: what is unfolded is no more than the longest phrase.
    windows = F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.slice("words", i, F.col("most")))
    windows = F.when(F.size("words") > 0, windows)
    places = words.select(id_column, F.explode(windows).alias("window"))
    met = places.withColumn("first", F.col("window")[0]).join(listed, "first")
    met = met.filter(F.array_join(F.slice("window", 1, F.col("length")), " ") == F.col("phrase"))
    return met.groupBy(id_column, "kind").agg(F.count("*").alias("hits"))


#: What an unmarked secret looks like: its length, letters and digits both, and how
#: evenly its characters are spread. Rules of our own.
SECRET_TOKEN = r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_-]{20,200}={0,2})(?![A-Za-z0-9+/_=-])"
SECRET_BITS = 3.2


def entropy_bits(token: Column) -> Column:
    """Shannon entropy of the characters of a token, in bits for each."""
    characters = F.split(token, "")
    counts = F.transform(
        F.array_distinct(characters), lambda c: F.size(F.filter(characters, lambda x: x == c)) / F.length(token)
    )
    return F.aggregate(counts, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def unmarked_secrets(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: float = SECRET_BITS
) -> DataFrame:
    """Tokens that look like keys wherever they stand: (id, token, bits), a row for each place.

    A token has 20 to 200 characters, letters and digits both, and at least ``bits``
    bits for each character, which words and numbers lack. Nothing is shuffled.
    """
    tokens = F.regexp_extract_all(F.col(text_column), F.lit(SECRET_TOKEN), F.lit(1))
    mixed = F.filter(tokens, lambda t: t.rlike("[0-9]") & t.rlike("[A-Za-z]"))
    rows = documents.select(id_column, F.explode(mixed).alias("token"))
    return rows.withColumn("bits", entropy_bits(F.col("token"))).filter(F.col("bits") >= bits)
