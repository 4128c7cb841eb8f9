"""Secret scans: candidates by pattern, false positives removed by a random forest; DataFrame and ML operations only.

A candidate is a run of at least ``SHORTEST`` key characters with a digit; a token may hold several.  Features: length, shares of digits and upper
case, changes of character class, distinct characters, share covered by dictionary words (letter runs of the tokens that hold
no candidate), a path around it, an assignment, and neighbouring words that name keys.

The tables hold no labelled findings.  Without a ``findings`` table the labels come from a rule on the context: a value
assigned to a key word is a secret, one that is digits only or part of a path is not; the rest stays unlabelled.  The
forest is fitted on at most ``MAX_ROWS`` labelled findings in hash order and scores all.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

SHORTEST, MAX_ROWS, TREES, DEPTH = 16, 20_000, 20, 5
#: Letter runs up to which the dictionary look-up is broadcast; above it the join shuffles.
BROADCAST_ROWS = 500_000
VALUE = rf"[A-Za-z0-9+/_\-]{{{SHORTEST},}}"
#: Whether a token holds a candidate: a whole run of key characters, long enough and with a digit.
HOLDING = rf"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z0-9+/_\-]{{{SHORTEST}}})[A-Za-z+/_\-]*[0-9]"
KEY = r"(?i)(token|secret|passw|apikey|api_key|credential|auth|private|access)"
FEATURES = ["length", "digits", "upper", "changes", "distinct", "covered", "path", "assigned", "key_near"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, at, nth, value, left, token): at counts the text's tokens between white space from 0, nth the runs of key
    characters in a token; left is what stands before the value, two tokens back at most."""
    tokens = docs.select(F.col(id_col).alias("id"), F.split(F.trim(F.coalesce(F.col(text_col), F.lit(""))), r"\s+").alias("ts"))
    each = tokens.select("id", "ts", F.posexplode("ts").alias("at", "token")).where(F.length("token") >= SHORTEST)
    near = F.concat_ws(" ", F.get("ts", F.col("at") - 2), F.get("ts", F.col("at") - 1))
    runs = each.select("id", "at", "token", near.alias("near"), F.posexplode(F.regexp_extract_all("token", F.lit(VALUE), F.lit(0))).alias("nth", "value"))
    head = F.substring("token", F.lit(1), F.expr("instr(token, value) - 1"))
    return runs.where(F.col("value").rlike("[0-9]")).select("id", "at", "nth", "value", F.concat_ws(" ", "near", head).alias("left"), "token")


def with_features(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    share = lambda p: F.regexp_count("value", F.lit(p)) / F.length("value")
    found = found.withColumns({
        "length": F.length("value").cast("double"), "digits": share("[0-9]"), "upper": share("[A-Z]"),
        "changes": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])"), "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "path": F.col("token").rlike(r"://|/[^/]*/").cast("double"), "assigned": F.col("left").rlike(r"[=:]\s*[\"'`(]*$").cast("double"),
        "key_near": F.col("left").rlike(KEY).cast("double"), "runs": F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{4,}"), F.lit(0)),
    })
    asked = stored(found.select(F.explode("runs").alias("run")).distinct())
    few = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    # Tokens with a candidate are left out, as every run of a value would stand in the dictionary by itself.
    others = F.filter(F.split(F.col(text_col), r"\s+"), lambda t: ~t.rlike(HOLDING))
    words = docs.select(F.explode(F.split(F.lower(F.concat_ws(" ", others)), r"[^a-z]+")).alias("run"))
    known = words.join(few, "run", "left_semi").distinct()
    covered = found.select("value", F.explode("runs").alias("run")).distinct().join(known, "run").groupBy("value").agg(F.sum(F.length("run")).alias("letters"))
    out = found.join(covered, "value", "left")
    return out.withColumn("covered", F.least(F.coalesce("letters", F.lit(0)) / F.length("value"), F.lit(1.0))).drop("letters", "runs")


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each candidate: id, at, nth, length, value_sha256, score, is_secret; texts without one give no row.

    ``findings`` (id, at, nth, label 0/1) are labelled candidates.  A null text has no candidate, repeated rows are answered
    each, other columns are ignored.  With labels of one class only every candidate gets that class; without labels the
    score is 0.
    """
    rows = stored(with_features(stored(candidates(docs, id_col, text_col)), docs, text_col))
    if findings is not None:
        labelled = rows.join(findings.select("id", "at", "nth", F.col("label").cast("double").alias("label")), ["id", "at", "nth"])
    else:
        rule = F.when((F.col("assigned") == 1) & (F.col("key_near") == 1) & (F.col("path") == 0), 1.0).when((F.col("digits") == 1) | (F.col("path") == 1), 0.0)
        labelled = rows.withColumn("label", rule)
    sample = stored(labelled.where("label IS NOT NULL").orderBy(F.xxhash64("value", "id"), "at", "nth").limit(MAX_ROWS).select("label", *FEATURES))
    classes = [r.label for r in sample.select("label").distinct().collect()]
    if len(classes) < 2:
        scored = rows.withColumn("score", F.lit(float(classes[0]) if classes else 0.0))
    else:
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="_x")
        forest = RandomForestClassifier(labelCol="label", featuresCol="_x", numTrees=TREES, maxDepth=DEPTH, seed=8)
        scored = forest.fit(assemble.transform(sample)).transform(assemble.transform(rows)).withColumn("score", vector_to_array("probability")[1])
    return scored.select(F.col("id").alias(id_col), F.col("at").cast("long").alias("at"), F.col("nth").cast("long").alias("nth"), F.col("length").cast("long").alias("length"), F.sha2("value", 256).alias("value_sha256"),
                         "score", (F.col("score") >= 0.5).alias("is_secret"))
