"""Secret scan: candidate strings, and a random forest that removes false positives (DataFrame functions only).

Candidates are found by two patterns. Values are what is assigned to a telling name (``password =
"hunter2!x"``), of any form and from four characters on, and the password in an address (``scheme://user:
password@host``). Runs are dotted tokens of three parts, at least 12 letters, digits, `_`, `+`, `/` or `-` with a
digit among them and up to two `=` after them, and at least 16 letters that change case several times. A run that
overlaps a value is left to it. Length and digits are features beyond that, not cuts.

The forest sees a candidate's length, kinds of characters and transitions between them, how much of
it is made of words of the corpus, whether it stands in a path or an address, and the words beside it.
It is trained on findings labelled by rule, at most SAMPLE_ROWS, half of each label or what the other one
leaves. Secrets are those with a provider's prefix, passwords in addresses, and assigned values that are no words;
others are plain numbers, parts of addresses and paths, and assigned words of the corpus. The
prefixes are no feature, and each finding is shown twice, once without the features of its surroundings, so that the
forest also judges by what a candidate is made of. Without both kinds of labels the rules alone decide.

Null texts are empty. Rows with equal doc_id and text share their result; every input row gives
one output row.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.common import stored, texts
from sparklog.llm.samples import shares

SAMPLE_ROWS = 6_000
TREES, DEPTH = 20, 6
PASS = 0.5
#: A corpus word is one of at least three letters that stands in so many places.
WORD_TIMES = 3

# Prefixes of public access-key formats, and names that secrets are assigned to.
PREFIX = r"^(AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abpr]-|sk_live_|rk_live_|npm_|ya29|eyJ)"
NAMES = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|credential|auth|private[_ -]?key|bearer)"

RUN = (
    r"(?<![A-Za-z0-9_+/-])(?:"
    r"(?=[A-Za-z_.-]*+[0-9])[A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]{6,}){2}(?![A-Za-z0-9_-])"
    r"|(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{12,}+={0,2}"
    r"|(?=[A-Za-z]{16})[A-Z]*(?:[a-z]+[A-Z]+){3}[A-Za-z]*+(?![A-Za-z0-9_+/-]))"
)
#: The value is the last group that matched, at the end of the match.
VALUE = (
    r"(?:(?i:passwords?|passwd|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|credentials?|private[_ -]?key|auth)[A-Za-z0-9_-]{0,12}[\"']?\s{0,2}(?:=|:(?!//))\s{0,2}[\"']?"
    r"([^\s\"'<>]{3,199}[^\s\"'<>.,;:)\]}]))"
    r"|(?:://[^\s/:@]{1,64}:([^\s/@]{3,199})(?=@))"
)

SURROUNDINGS = ["path", "address", "assigned", "named_before", "named_after", "quoted", "login"]
FEATURES = ["length", "digits", "uppers", "lowers", "signs", "runs", "kinds", "hex", "number", "words", *SURROUNDINGS]


def _located(docs: DataFrame, pattern: str, value: Column) -> DataFrame:
    """(doc_id, _text, start, end, candidate, before, after) of the pattern's matches; places in code points.

    The candidate is the end of a match; `value` gives it from `_match`, a struct of the match and its two groups.
    """
    parts = F.arrays_zip(
        F.split("text", pattern).alias("between"),
        *[F.regexp_extract_all("text", F.lit(pattern), F.lit(k)).alias(f"g{k}") for k in range(3 if "([^" in pattern else 1)],
    )
    cut = docs.where(F.col("text").rlike(pattern)).select("doc_id", F.xxhash64("text").alias("_text"), parts.alias("_parts"))
    near = F.transform(
        "_parts",
        lambda p: F.struct(F.length(p["between"]).alias("gap"), F.right(p["between"], F.lit(60)).alias("before"), F.left(p["between"], F.lit(30)).alias("after"), p["g0"].alias("found"), value(p).alias("value")),
    )
    small = cut.select("doc_id", "_text", near.alias("_near")).dropDuplicates(["doc_id", "_text"])
    each = small.select("doc_id", "_text", F.posexplode("_near").alias("_n", "_p")).select("doc_id", "_text", "_n", "_p.*")
    order = Window.partitionBy("doc_id", "_text").orderBy("_n")
    size = F.coalesce(F.length("found"), F.lit(0))
    placed = each.withColumn("end", F.sum(F.col("gap") + size).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.lead("after").over(order))
    name = F.expr("left(found, length(found) - length(value))")
    return placed.where("found IS NOT NULL").select(
        "doc_id",
        "_text",
        (F.col("end") - F.length("value")).alias("start"),
        "end",
        F.col("value").alias("candidate"),
        F.right(F.concat("before", name), F.lit(60)).alias("before"),
        F.coalesce("next", F.lit("")).alias("after"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, start, end, candidate, before, after) of (doc_id, text); no two of a text overlap."""
    named = docs.where(F.col("text").contains("://") | F.col("text").rlike(NAMES))
    values = _located(named, VALUE, lambda p: F.when(p["g1"] != "", p["g1"]).otherwise(p["g2"])).withColumn("_kind", F.lit(0))
    runs = _located(docs, RUN, lambda p: p["g0"]).withColumn("_kind", F.lit(1))
    both = values.unionByName(runs)
    # a run goes if a value begins before its end and ends after its beginning
    order = Window.partitionBy("doc_id", "_text").orderBy("start", "_kind")
    value_end, value_start = F.when(F.col("_kind") == 0, F.col("end")), F.when(F.col("_kind") == 0, F.col("start"))
    before = F.max(value_end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(value_start).over(order.rowsBetween(1, Window.unboundedFollowing))
    crossed = (F.coalesce(before, F.lit(0)) > F.col("start")) | F.coalesce(after < F.col("end"), F.lit(False))
    marked = both.withColumn("_crossed", crossed & (F.col("_kind") == 1))
    return marked.where(~F.col("_crossed")).drop("_crossed", "_kind")


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, times): words of the whole corpus, lower-cased, that stand in at least WORD_TIMES places."""
    words = docs.select(F.explode(F.split(F.lower("text"), "[^\\p{L}]+")).alias("word")).where(F.length("word") >= 3)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= WORD_TIMES)


def _share(pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace("candidate", pattern, "")) / F.length("candidate")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """`found` with the FEATURES and `rule`, the label by rule or null."""
    runs = found.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,}"), F.lit(0))).alias("run"))
    covered = runs.join(words, F.col("run") == F.col("word")).groupBy(F.col("candidate").alias("_c")).agg(F.sum(F.length("run")).alias("_covered"))
    joined = found.join(covered, F.col("candidate") == F.col("_c"), "left")
    flag = lambda c: c.cast("double")
    rows = joined.select(
        *found.columns,
        F.least(F.length("candidate"), F.lit(200)).cast("double").alias("length"),
        _share("[0-9]").alias("digits"),
        _share("[A-Z]").alias("uppers"),
        _share("[a-z]").alias("lowers"),
        _share("[^A-Za-z0-9]").alias("signs"),
        (F.size(F.regexp_extract_all("candidate", F.lit("[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))) / F.length("candidate")).alias("runs"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate")).alias("kinds"),
        flag(F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex"),
        flag(F.col("candidate").rlike("^[0-9-]+$")).alias("number"),
        (F.coalesce("_covered", F.lit(0)) / F.length("candidate")).alias("words"),
        flag(F.col("candidate").contains("/") | F.col("before").rlike(r"[/\\.]$") | F.col("after").rlike(r"^[/\\]")).alias("path"),
        flag(F.col("before").endswith("@") | F.col("after").startswith("@") | F.col("before").rlike(r"@\S*$")).alias("address"),
        flag(F.col("before").rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        flag(F.col("before").rlike(NAMES + r"\S{0,12}\s{0,2}[=:]?\s{0,2}[\"']?$")).alias("named_before"),
        flag(F.col("after").rlike(r"^\W{0,3}\s?" + NAMES)).alias("named_after"),
        flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).alias("quoted"),
        flag(F.col("before").rlike(r"://[^\s/:@]+:$") & F.col("after").startswith("@")).alias("login"),
    )
    assigned = (F.col("named_before") == 1) & (F.col("assigned") == 1)
    wordy = (F.col("words") >= 0.8) & (F.col("digits") == 0) & (F.length("candidate") < 16)
    secret = F.col("candidate").rlike(PREFIX) | (F.col("login") == 1) | (assigned & ~wordy)
    other = (F.col("number") == 1) | (F.col("address") == 1) | (F.col("path") == 1) | (assigned & wordy)
    return rows.withColumn("rule", F.when(secret, 1).when(other, 0))


def training_sample(rows: DataFrame) -> DataFrame:
    """(label, FEATURES) of at most SAMPLE_ROWS distinct findings by label, and again without their surroundings."""
    labelled = rows.where("rule IS NOT NULL").select(F.col("rule").alias("label"), "candidate", *FEATURES).dropDuplicates(["candidate"])
    totals = {row["label"]: row["count"] for row in labelled.groupBy("label").count().collect()}
    chosen = labelled.limit(0)
    for kind, n in sorted(shares(totals, SAMPLE_ROWS).items()):
        chosen = chosen.unionByName(labelled.where(F.col("label") == kind).orderBy(F.xxhash64("candidate"), "candidate").limit(n))
    bare = chosen.select("label", "candidate", *[F.lit(0.0).alias(name) if name in SURROUNDINGS else F.col(name) for name in FEATURES])
    return stored(chosen.unionByName(bare).coalesce(1), "findings")


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, _text, start, end, candidate, score): every candidate with the forest's score."""
    found = stored(candidates(docs), "candidates")
    rows = stored(featured(found, corpus_words(docs)), "featured")
    sample = training_sample(rows)
    if sample.select("label").distinct().count() < 2:
        return rows.select("doc_id", "_text", "start", "end", "candidate", F.coalesce(F.col("rule"), F.lit(0)).cast("double").alias("score"))
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=11)
    model = forest.fit(assembler.transform(sample).select("label", "features"))
    scored = model.transform(assembler.transform(rows))
    return scored.select("doc_id", "_text", "start", "end", "candidate", vector_to_array("probability")[1].alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, spans) of every document; spans are start:end:score of what is kept, by start."""
    rows = texts(docs)
    kept = F.col("score") >= PASS
    span = F.struct("start", "end", F.round("score", 3).alias("score"))
    summed = (
        findings(rows)
        .groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"))
        .agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(kept, 1)).alias("_kept"), F.array_sort(F.collect_list(F.when(kept, span))).alias("_spans"))
    )
    keyed = rows.select("doc_id", F.xxhash64("text").alias("_text"))
    joined = keyed.join(summed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), "left")
    listed = F.transform("_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["score"].cast("string")))
    return joined.select(
        "doc_id",
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_candidates"),
        F.coalesce("_kept", F.lit(0)).cast("long").alias("n_secrets"),
        F.coalesce(F.array_join(listed, ","), F.lit("")).alias("spans"),
    )
