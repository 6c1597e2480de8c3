"""Word lists and character sets as files. Files are read whole, so lines keep their order and split as Python's do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import characters, normalize_text
from ..operators.lexicon import first_seen

#: Everything that ends a line.
LINE_END = "\\r\\n|[\\n\\x0B\\x0C\\r\\x1C-\\x1E\\x85\\x{2028}\\x{2029}]"
#: Named lexicons and their files, filled by ``name_lexicon``.
LEXICON_FILES: dict[str, tuple[str, ...]] = {}


def name_lexicon(name: str, *files: str) -> None:
    """Let ``load_lexicon`` find a lexicon, of one file or several in order, by a name."""
    LEXICON_FILES[name] = files


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(part, ord, line) of whole files, in the order given."""
    out = None
    for part, path in enumerate(paths):
        one = spark.read.text(path, wholetext=True).select(F.lit(part).alias("part"), F.posexplode(F.split("value", LINE_END)).alias("ord", "line"))
        out = one if out is None else out.unionByName(one)
    return out


def read_terms(spark: SparkSession, paths: str | list[str], domain: str) -> DataFrame:
    """A lexicon (domain, ord, term): one word a line, white space removed, empties dropped, first seen kept."""
    own = lines(spark, [paths] if isinstance(paths, str) else paths).select("part", F.col("ord").cast("long").alias("ord"), normalize_text(F.col("line")).alias("term"))
    seen = first_seen(own.where("term <> ''"), ["term"], ["part", "ord"])
    return seen.select(F.lit(domain).alias("domain"), (F.col("part") * F.lit(1 << 32) + F.col("ord")).alias("ord"), "term")


def lexicon_from_terms(spark: SparkSession, domain: str, terms: list[str]) -> DataFrame:
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(terms)], "ord long, term string").withColumn("term", normalize_text(F.col("term")))
    return first_seen(rows.where("term <> ''"), ["term"], ["ord"]).select(F.lit(domain).alias("domain"), "ord", "term")


def load_lexicon(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A lexicon by its name in the catalogue, or by the path of a file."""
    if name in LEXICON_FILES:
        return read_terms(spark, [f"{folder.rstrip('/')}/{f}" for f in LEXICON_FILES[name]], name)
    if not name:
        raise ValueError("a lexicon needs a name or a path")
    return read_terms(spark, name, name.rsplit("/", 1)[-1].rsplit(".", 1)[0])


def read_charset(spark: SparkSession, path: str) -> DataFrame:
    """(char_id, ch): a class for each character that isn't white space; blank lines and # lines are left out."""
    own = lines(spark, [path]).where("trim(line) <> '' and not startswith(ltrim(line), '#')")
    chars = own.select("ord", F.posexplode(characters(normalize_text(F.col("line")))).alias("pos", "ch"))
    everything = chars.agg(F.sort_array(F.collect_list(F.struct("ord", "pos", "ch"))).alias("all"))  # a charset is a small file
    return everything.select(F.posexplode("all").alias("char_id", "c")).select("char_id", "c.ch")


def write_lines(df: DataFrame, column: str, order: str, path: str) -> None:
    """One text file in order. A list is a small file by its nature."""
    df.select(column, order).coalesce(1).sortWithinPartitions(order).select(column).write.mode("overwrite").text(path)


def read_tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON with bare numeric keys: they are quoted outside of strings, then parsed."""
    text = spark.read.text(path, wholetext=True)
    # A string is matched and put back; else a bare number before a colon is quoted.
    quoted = F.regexp_replace("value", '("(?:\\\\.|[^"\\\\])*+")|(?<=[{,\\s])(-?\\d+)(?=\\s*:)', "$1<<$2>>")
    plain = F.regexp_replace(F.regexp_replace(quoted, "<<>>", ""), "<<(-?\\d+)>>", '"$1"')
    return text.select(F.from_json(plain, schema).alias("data"))


def field_texts(data: DataFrame, field: str) -> DataFrame:
    """Non-empty texts of a field over an array ``sequence``, first seen kept."""
    rows = data.select(F.posexplode("data.sequence").alias("ord", "item")).select(F.col("ord").cast("long").alias("ord"), F.col("item")[field].alias("text"))
    return first_seen(rows.where("text is not null and text <> ''"), ["text"], ["ord"])


def upsert_category(manifest: DataFrame, fresh: DataFrame, category: str) -> DataFrame:
    """Replace the rows of one category, keep the others."""
    return manifest.where(F.col("category") != category).unionByName(fresh.withColumn("category", F.lit(category)), allowMissingColumns=True)
