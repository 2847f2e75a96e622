"""Secret scan with a random forest that removes false findings; built-in functions only.

Candidates are found by a pattern. Each is described by its length, by how usual its character transitions are in the corpus, by the
share of it that dictionary words cover, by whether it stands in a path, and by the words next to it. A forest learnt from labelled
findings votes on each; its trees are evaluated as SQL expressions.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import Scratch

from .common import free_name

#: Shortest candidate, characters of context on either side, and the mark that replaces a secret.
LEAST, CONTEXT, MASK = 16, 48, "[SECRET]"
#: A candidate: a run of at least ``LEAST`` such characters with a digit, and padding.
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{{{LEAST},}}+={{0,2}}"
#: Words by which credentials are usually named.
NAMES = "token|secret|passw|passphrase|pwd|api.?key|access.?key|private.?key|auth|credential|bearer|signature"
FEATURES = ["length", "transitions", "coverage", "path", "named", "assigned", "quoted", "known_before", "known_after"]
#: Labelled findings from which a forest is learnt, its trees and their depth, and the share of votes for a secret.
TRAIN_ROWS, TREES, DEPTH, VOTES = 20_000, 25, 5, 0.5


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of all runs of ASCII letters, in lower case, over all texts."""
    return docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def as_classes(value):
    """Letters in lower case, digits as 0, all else as -: the alphabet of transitions."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[0-9]", "0"), "[^a-z0]", "-")


def pairs_of(text):
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substring(text, i, F.lit(2)))


def transitions(words: DataFrame) -> DataFrame:
    """One row with a map from two characters to the log share of the second after the first, over all words of the corpus.

    The map has 38 * 38 entries at most. Pairs that no word has get the log of half a count.
    """
    pairs = words.filter("length(word) > 1").select(F.explode(pairs_of(F.concat(F.lit("-"), F.col("word"), F.lit("-")))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    first = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("total"))
    logs = pairs.join(first, F.substring("pair", 1, 1) == F.col("first")).select("pair", F.log((F.col("n") + 0.5) / (F.col("total") + 19.0)).alias("p"))
    return logs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("pair", "p")))).alias("logs"))


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, row, number, start, value, before, after`` of every candidate; ``start`` counts characters from 0."""
    parts, values = F.split("text", CANDIDATE), F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))
    found = docs.filter(F.col("text").rlike(CANDIDATE)).select("doc_id", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"), parts.alias("parts"), values.alias("found"))
    each = F.transform(F.sequence(F.lit(0), F.size("found") - 1), lambda i: F.struct(
        F.get("found", i).alias("value"), F.length(F.get("parts", i)).cast("bigint").alias("gap"), F.right(F.get("parts", i), F.lit(CONTEXT)).alias("before"), F.left(F.get("parts", i + 1), F.lit(CONTEXT)).alias("after")))
    rows = found.select("doc_id", "text_hash", "row", F.posexplode(each).alias("number", "c")).select("doc_id", "text_hash", "row", "number", "c.*")
    upto = Window.partitionBy("row").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("value")).over(upto) - F.length("value")
    return rows.withColumn("start", start).drop("gap")


def described(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with the columns of ``FEATURES``, all double."""
    logs = transitions(words)
    steps = F.transform(pairs_of(as_classes(F.col("value"))), lambda p: F.coalesce(F.try_element_at(F.col("logs"), p), F.lit(-12.0)))
    runs = F.filter(F.split(F.lower("value"), "[^a-z]+"), lambda w: F.length(w) >= 3)
    last, next_ = F.lower(F.regexp_extract("before", "([A-Za-z]+)[^A-Za-z]*$", 1)), F.lower(F.regexp_extract("after", "^[^A-Za-z]*([A-Za-z]+)", 1))
    found = found.withColumns({"last": last, "next": next_})
    asked = found.select("row", "number", F.explode(F.concat(F.transform(runs, lambda w: F.struct(F.lit("in").alias("at"), w.alias("word"))), F.array(F.struct(F.lit("last").alias("at"), F.col("last").alias("word")), F.struct(F.lit("next").alias("at"), F.col("next").alias("word"))))).alias("x")).select("row", "number", "x.*").filter("word <> ''")
    wanted = asked.select("word").distinct()
    known = words.filter("n > 1").join(wanted, "word", "left_semi").select("word")
    told = asked.join(known, "word").groupBy("row", "number").agg(
        F.sum(F.when(F.col("at") == "in", F.length("word"))).alias("covered"), F.max(F.when(F.col("at") == "last", 1.0)).alias("known_before"), F.max(F.when(F.col("at") == "next", 1.0)).alias("known_after"))
    near = F.lower("before")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return found.join(told, ["row", "number"], "left").join(F.broadcast(logs)).select(
        "doc_id", "text_hash", "row", "number", "start", "value", "before", "after",
        F.length("value").cast("double").alias("length"),
        F.coalesce(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.size(steps), F.lit(0.0)).alias("transitions"),
        (F.coalesce("covered", F.lit(0)) / F.length("value")).alias("coverage"),
        flag(F.col("value").contains("/") | F.col("before").rlike(r"(://|[/\\@.])\S*$") | F.col("after").rlike(r"^[/\\@]|^\.\w")).alias("path"),
        flag(near.rlike(rf"({NAMES})[^.!?]{{0,16}}$")).alias("named"),
        flag(near.rlike("[=:]>?\\s{0,2}[\"'`]?$")).alias("assigned"),
        flag(near.rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")).alias("quoted"),
        F.coalesce("known_before", F.lit(0.0)).alias("known_before"), F.coalesce("known_after", F.lit(0.0)).alias("known_after"))


def weak_labels(found: DataFrame) -> DataFrame:
    """Labelled findings (column ``label``) where no reviewed ones are at hand.

    True: mixed letters and digits, assigned to a credential's name. False: no name and no assignment, or digits alone, or in a path.
    Findings that fit neither are left out.
    """
    mixed = F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]")
    true = mixed & (F.col("named") + F.col("assigned") == 2) & (F.col("path") == 0)
    false = (F.col("named") + F.col("assigned") == 0) | ~mixed | (F.col("path") == 1)
    return found.withColumn("label", F.when(true, 1.0).when(false, 0.0)).filter("label is not null")


def learn_forest(labelled: DataFrame, rows: int = TRAIN_ROWS, trees: int = TREES, depth: int = DEPTH) -> F.Column:
    """The forest's share of votes for a secret, as an expression over ``FEATURES``.

    About ``rows`` labelled findings at most are used, half of each class, drawn by a hash. With one class alone, or no finding, the
    expression is a constant.
    """
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return F.lit(float(next(iter(sizes), 0.0)))
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    part = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows / 2 / n))])
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", "value", "start"), F.lit(1 << 20)) < F.element_at(part, F.col("label")) * (1 << 20))
    if sample.select("label").distinct().count() < 2:
        sample = labelled
    weight = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, 1.0 / min(n, rows / 2))])
    table = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.withColumn("weight", F.element_at(weight, F.col("label")) * 1000.0)).select("features", "label", "weight")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt", weightCol="weight").fit(table)
    votes = [tree_expression(t.toDebugString) for t in model.trees]
    total = votes[0]
    for v in votes[1:]:
        total = total + v
    return total / F.lit(float(len(votes)))


def tree_expression(description: str) -> F.Column:
    """The expression of a tree that is described line by line (If, Else, Predict), one blank deeper a level."""
    lines = [x.strip() for x in description.splitlines()[1:] if x.strip()]
    at = 0

    def node() -> F.Column:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict:"):
            return F.lit(float(line.split(":")[1]))
        feature, limit = re.fullmatch(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = node()
        at += 1  # the line of Else
        return F.when(F.col(FEATURES[int(feature)]) <= float(limit), low).otherwise(node())

    return node()


def scan(docs: DataFrame, scratch: Scratch, labelled=weak_labels) -> DataFrame:
    """Every candidate of every text: ``doc_id, text_hash, number, start, length, value, score, secret``.

    ``labelled`` picks labelled findings from the described candidates (column ``label``, 1.0 or 0.0). Words and transitions are
    counted over all texts. Null and empty texts have no candidates; rows that repeat are scanned each; null ids are kept; without
    any candidate the result is empty. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null")
    words = scratch.keep(word_counts(docs))
    found = scratch.keep(described(scratch.keep(candidates(docs)), words))
    votes = learn_forest(labelled(found))
    return found.withColumn("score", votes).select("doc_id", "text_hash", "number", "start", F.length("value").cast("bigint").alias("length"), "value", "score", (F.col("score") >= VOTES).alias("secret"))


def redact(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` with every secret replaced by ``MASK`` (and ``n_chars``, where there is one, counted anew); all rows and columns stay."""
    secrets = scan(docs, scratch).filter("secret").groupBy("doc_id", "text_hash").agg(F.collect_set("value").alias("values"))
    secrets = scratch.keep(secrets.select(F.col("doc_id").alias("secret_doc"), F.col("text_hash").alias("secret_text"), F.array_sort("values", lambda a, b: F.length(b) - F.length(a)).alias("values")))
    names, key = docs.columns, free_name(docs, "text_hash")
    plain = docs.withColumn(key, F.xxhash64("text"))
    spare = {c: free_name(docs, c) for c in secrets.columns}
    secrets = secrets.withColumnsRenamed(spare)
    joined = plain.join(secrets, plain["doc_id"].cast("bigint").eqNullSafe(secrets[spare["secret_doc"]]) & (plain[key] == secrets[spare["secret_text"]]), "left")
    values = F.col(f"`{spare['values']}`")
    out = joined.withColumn("text", F.when(values.isNull(), F.col("text")).otherwise(F.aggregate(values, F.col("text"), lambda t, v: F.replace(t, v, F.lit(MASK)))))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(values.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*names)
