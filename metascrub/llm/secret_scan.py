"""Secret scanning with a random forest that removes false positives; built-in functions and Spark ML alone.

Candidates are, whatever their length unless one is told here: private-key blocks from BEGIN to the END of the same label;
behind a secret's name, with any blanks and an equals sign or colon, values in quotes of four characters or more (a quote
behind a backslash belongs to the value) and values without quotes of four or more that hold a digit, or that follow an
equals sign; passwords of four or more in ``scheme://user:password@host``; and all runs of 12 or more key characters with a
digit in them. Each is described by its length, the transitions between classes of its characters, how much of it common
words of the corpus cover, the path it stands in (the source) and the words next to it. The forest is trained on labelled
findings and keeps what it takes for a secret. ``weak_labels`` labels findings by strict rules where nobody has labelled any.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metascrub.llm import text as tx

CHARS = r"A-Za-z0-9_+/.\-"
NEAR = 40  #: characters of the surroundings that are looked at
COMMON = 400  #: words of the dictionary
#: Names before a value that make it a secret, formats that are one by themselves, words of harmless values.
NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth", "credential", "private_key")
FORMATS = ("^AKIA[A-Z0-9]{16}$", "^gh[pousr]_[A-Za-z0-9]{36}$", "^xox[abprs]-[A-Za-z0-9-]{10,}$", "^glpat-[A-Za-z0-9_-]{20}$", "^-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*-----")
HARMLESS = ("commit", "checksum", "digest", "uuid", "example", "placeholder", "revision", "version")
BEGIN = "-----BEGIN "
#: What stands before a value: a name and its assignment, or a scheme and a user. Possessive, so that nothing is tried twice.
NAMED = rf"""(?i:{"|".join(NAMES)})["']?+\s*+"""
USER = r"""://[^\s/:@"'<>]*+:"""
QUOTED = r"""[=:]\s*+(?:"(?:[^"\\\r\n]|\\[^\r\n]){4,}+|'(?:[^'\\\r\n]|\\[^\r\n]){4,}+)"""
BARE = r"""(?:=\s*+[^\s"'<>,;]{4,}+|:\s*+(?=[^\s0-9"'<>,;]*+[0-9])[^\s"'<>,;]{4,}+)"""
ASSIGNED = rf"(?:{NAMED}(?:{QUOTED}|{BARE})|{USER}[^\s/@\"'<>]{{4,}}+(?=@))"
HEAD = rf"""^(?:{NAMED}[=:]\s*+["']?+|{USER})"""
RUN = rf"(?<![{CHARS}])(?=[A-Za-z_+/.\-]*+[0-9])[{CHARS}]{{12,}}(?<![.\-])"
MARK = "[REDACTED]"
ROW = ("doc_id", "source", "text")  #: what candidates come from; rows alike in these have the same ones
FOUND = ["row", "doc_id", "source", "n", "value", "score"]


def _pairs(text: Column, pattern: str) -> tuple[Column, Column]:
    """Gaps and matches: the text is gaps[0], matches[0], gaps[1], ... and a last gap."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)


def _blocks(text: Column) -> Column:
    """The text as pieces (gap, value), one behind the other, with each key block as a value; found by its marks, in one pass."""

    def piece(part: Column, k: Column) -> Column:
        label = F.substring_index(part, "-----", 1)
        end = F.concat(F.lit("-----END "), label, F.lit("-----"))
        at = F.instr(part, end)
        size = at + F.char_length(end) - 1
        block = (k > 0) & label.rlike("^[A-Z0-9 ]*PRIVATE KEY[A-Z0-9 ]*$") & (at > 0)
        whole = F.when(k > 0, F.concat(F.lit(BEGIN), part)).otherwise(part)
        return F.when(block, F.struct(F.concat(F.lit(BEGIN), F.left(part, size)).alias("value"), F.substr(part, size + 1).alias("gap"))).otherwise(F.struct(F.lit(None).cast("string").alias("value"), whole.alias("gap")))

    return F.when(F.contains(text, F.lit(BEGIN)), F.transform(F.split(text, BEGIN, -1), piece)).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("value"), text.alias("gap"))))


def _named(piece: Column) -> Column:
    """A piece as pieces (value, head, gap), one for each assigned value; head is the name that stands before the value."""
    gaps, found = _pairs(piece["gap"], ASSIGNED)
    head = lambda m: F.regexp_extract(m, HEAD, 0)
    values = F.concat(F.array(F.struct(piece["value"].alias("value"), F.lit("").alias("head"))), F.transform(found, lambda m: F.struct(F.substr(m, F.char_length(head(m)) + 1).alias("value"), head(m).alias("head"))))
    return F.zip_with(values, gaps, lambda v, g: F.struct(v["value"].alias("value"), v["head"].alias("head"), g.alias("gap")))


def _runs(piece: Column) -> Column:
    """A piece as pieces: each run of key characters in its gap is a value."""
    gaps, found = _pairs(piece["gap"], RUN)
    return F.zip_with(F.concat(F.array(piece["value"]), found), gaps, lambda v, g: F.struct(v.alias("value"), g.alias("gap")))


def has_candidate(text: Column) -> Column:
    """Whether a text may have one: all texts with candidates, and those with a key block's first mark."""
    return F.coalesce(text.rlike(RUN) | text.contains(BEGIN) | (text.rlike("[=:]") & text.rlike(ASSIGNED)), F.lit(False))


def _split(docs: DataFrame) -> DataFrame:
    """docs with gaps and values: the text is gaps[0], values[0], gaps[1], ... and a last gap; a null value is nothing."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = F.when(text.rlike("[=:]"), F.flatten(F.transform("_p", _named))).otherwise(F.transform("_p", lambda x: F.struct(x["value"].alias("value"), F.lit("").alias("head"), x["gap"].alias("gap"))))
    docs = docs.withColumn("_p", _blocks(text)).withColumn("_p", named)
    # the head of the next value belongs to the gap
    docs = docs.withColumn("_p", F.zip_with("_p", F.slice("_p", F.lit(2), F.size("_p")), lambda x, y: F.struct(x["value"].alias("value"), F.concat(x["gap"], F.coalesce(y["head"], F.lit(""))).alias("gap"))))
    docs = docs.withColumn("_p", F.flatten(F.transform("_p", _runs)))
    return docs.withColumns({"_gaps": F.transform("_p", lambda x: x["gap"]), "_values": F.transform(F.slice("_p", F.lit(2), F.size("_p")), lambda x: x["value"])}).drop("_p")


def candidates(docs: DataFrame) -> DataFrame:
    """row (a hash of doc_id, source and text), doc_id, source, n (ordinal in the text, from 0), value, before, after: one row
    for each candidate. Null, empty and blank texts have none; a null source is the empty path; rows are scanned one by one,
    repeated ones too."""
    rows = docs.filter(has_candidate(F.col("text"))).select(tx.row_key(*ROW).alias("row"), "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    rows = _split(rows).select("row", "doc_id", "source", "_values", F.transform("_gaps", lambda g: F.struct(F.right(g, F.lit(NEAR)).alias("r"), F.left(g, F.lit(NEAR)).alias("l"))).alias("_gaps"))
    rows = rows.select("row", "doc_id", "source", F.posexplode_outer(F.arrays_zip("_values", F.expr("slice(_gaps, 1, size(_values))").alias("_b"), F.expr("slice(_gaps, 2, size(_values))").alias("_a"))).alias("n", "x"))
    return rows.select("row", "doc_id", "source", "n", F.col("x._values").alias("value"), F.col("x._b.r").alias("before"), F.col("x._a.l").alias("after")).filter("value is not null")


def dictionary(docs: DataFrame, most: int = COMMON) -> list[str]:
    """The ``most`` most frequent words of 4 to 6 small ASCII letters in all documents; ties by the word."""
    found = docs.select(F.explode_outer(F.regexp_extract_all("text", F.lit(r"\b([a-z]{4,6})\b"), 1)).alias("w")).filter("w is not null")
    return [r["w"] for r in found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(most).collect()]


def features(found: DataFrame, common: list[str]) -> DataFrame:
    """found with what the forest looks at."""
    value = F.col("value")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0"), "[^aA0]", "-")
    size = F.char_length("value").cast("double")
    share = lambda c: (F.regexp_count(value, F.lit(c)) / size).cast("double")
    left = F.regexp_replace(F.lower(F.lit("") if not common else value), "|".join(sorted(common, key=lambda w: (-len(w), w))) or "^$", "")
    return found.withColumns({
        "f_length": size,
        "f_transitions": (F.regexp_count(kinds, F.lit(r"(.)\1*")) - 1) / size,
        "f_dictionary": (size - F.char_length(left)) / size if common else F.lit(0.0),
        "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_dots": share("[./]"), "f_hex": F.expr("double(value rlike '^[0-9a-f]+$')"),
        "f_distinct": F.size(F.array_distinct(F.split("value", ""))) / size,
        "f_assigned": F.col("before").rlike(r"""[=:]\s*["']?$""").cast("double"),
        "w_before": F.lower(F.regexp_extract("before", r"([A-Za-z_]+)[^A-Za-z_]*$", 1)),
        "w_after": F.lower(F.regexp_extract("after", r"^[^A-Za-z_]*([A-Za-z_]+)", 1)),
        "w_path": F.col("source"),
    })


NUMBERS = ["f_length", "f_transitions", "f_dictionary", "f_digits", "f_upper", "f_dots", "f_hex", "f_distinct", "f_assigned"]


def weak_labels() -> Column:
    """1 for findings of a secret's format, or with a letter and assigned to a secret's name, else 0."""
    named = (F.lower("before").rlike(rf"""(?:{"|".join(NAMES)})["']?\s*[=:]\s*["']?$""") | F.col("before").rlike(rf"{USER}$")) & F.col("value").rlike("[A-Za-z]")
    harmless = F.lower(F.concat("before", F.col("value"))).rlike("|".join(HARMLESS))
    return ((F.col("value").rlike("|".join(FORMATS)) | named) & ~harmless).cast("double")


def train(labelled: DataFrame, common: list[str], most: int = 4000, trees: int = 20, depth: int = 6, seed: int = 7) -> PipelineModel | None:
    """The forest for findings with a label (0 or 1), of each label at most ``most``, those with the least hash. None if
    only one label is there: then no finding can be told from another and all candidates stay as their rule says."""
    rank = lambda k: labelled.filter(F.col("label") == k).orderBy(F.xxhash64("value", "doc_id", "n"), "value", "doc_id", "n").limit(most)
    rows = features(rank(0).unionAll(rank(1)), common).persist()
    try:
        if rows.select("label").distinct().count() < 2:
            return None
        hasher = FeatureHasher(inputCols=["w_before", "w_after", "w_path"], outputCol="words", numFeatures=128)
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird")
        return Pipeline(stages=[hasher, VectorAssembler(inputCols=[*NUMBERS, "words"], outputCol="features"), forest]).fit(rows)
    finally:
        rows.unpersist()


def scan(docs: DataFrame, model: PipelineModel | None, common: list[str], least: float = 0.5) -> DataFrame:
    """FOUND: the candidates that the forest takes for secrets; without a forest those of the rules."""
    found = candidates(docs)
    if model is None:
        return found.withColumn("score", weak_labels()).filter(F.col("score") >= least).select(FOUND)
    scored = model.transform(features(found, common)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.filter(F.col("score") >= least).select(FOUND)


def fit(docs: DataFrame) -> tuple[PipelineModel | None, list[str]]:
    """The forest and the dictionary of a corpus without labelled findings."""
    common = dictionary(docs)
    return train(candidates(docs).withColumn("label", weak_labels()), common), common


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, all columns, with MARK in place of each value found in the row itself, whatever its doc_id, and n_chars, if it is
    there, anew. found: of ``scan`` over the same docs. Rows without a candidate, null and empty texts among them, stay as
    they are and where they are; extra columns of any names stay."""
    own = found.groupBy(F.col("row").alias("_row")).agg(F.collect_set("value").alias("_secrets"))
    maybe = has_candidate(F.col("text"))
    whole = docs.filter(maybe).select(F.struct(*docs.columns).alias("_whole"), tx.row_key(*ROW).alias("_row"), F.col("text"))
    rows = _split(whole.join(own, "_row", "left").withColumn("text", F.when(F.col("_secrets").isNotNull(), F.col("text"))))
    told = F.concat_ws("", F.transform(F.arrays_zip("_gaps", "_values"), lambda x: F.concat(F.coalesce(x["_gaps"], F.lit("")), F.when(F.array_contains("_secrets", x["_values"]), MARK).otherwise(F.coalesce(x["_values"], F.lit(""))))))
    rows = rows.select("_whole", "_secrets", F.when(F.col("_secrets").isNotNull(), told).alias("_told"))
    plain = {c: F.col("_whole").getField(c) for c in docs.columns}
    anew = {"text": F.col("_told").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        anew["n_chars"] = F.char_length("_told").cast(docs.schema["n_chars"].dataType)
    rows = rows.select(*[F.when(F.col("_secrets").isNull(), plain[c]).otherwise(anew.get(c, plain[c])).alias(c) for c in docs.columns])
    return docs.filter(~maybe).unionByName(rows)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every secret in all documents; the forest learns from findings labelled by the rules."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, *fit(docs)).drop("row")
