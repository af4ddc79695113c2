"""Secret scan with a random forest that removes false findings.

A candidate is each run of at least ``min_chars`` key characters with a digit inside a word, and each run of at least
``min_named`` of them, with or without a digit, that is assigned to a key-like name (``password=...``), in its own word
or with the name in the one or two words before it. Its features are length, shares
of character classes, entropy, transitions (class changes, and the mean log-probability of its letter pairs under the
corpus's own dictionary), the share that dictionary words cover, the path of the document and the words around it. The
dictionary is counted over all documents. A forest (Spark ML) is fitted on labelled findings and scores all candidates.

Labelled findings are rows (finding, is_secret), finding being the SHA-256 of the candidate. Where none are given,
``stated_labels`` labels the clear cases: what well-known key formats or quoted assignments to key-like names say is a
secret, and plain numbers, dictionary text and placeholders, which aren't.

Defined results: null and empty texts have no candidates. Repeated rows give repeated findings; a null id or path is
kept as null. With labels of one class only, or none, no forest is fitted: what the stated rules call a secret is one,
with a null score. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.shared import materialize

#: Published key formats, names of keys, and words of placeholders and of paths that hold examples.
FORMATS = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|glpat-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_=-]{20,})"
NAMES = r"(?i)(?:token|secret|passw(?:or)?d|api_?-?key|access_?-?key|private_?-?key|auth|credential|bearer)"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?|xxxx|0000000|1234567"
EXAMPLES = r"(?i)(?:^|[/_.-])(?:test|tests|example|examples|sample|mock|fixture|doc|docs)(?:$|[/_.-])"
_KEY = r"[A-Za-z0-9_+/=-]"
#: A key-like name up to its end, and the sign between it and its value.
_NAMED = NAMES + r"[A-Za-z0-9_-]{0,20}"
_ASSIGN = r"[\"'`]?\s*(?:=>|:=|[=:])\s*[\"'`(\[{]*"
FEATURES = ["n_chars", "digits", "uppers", "lowers", "others", "entropy", "changes", "hex", "pair_logp", "covered", "in_examples", "path_depth", "named", "assigned", "quoted", "next_word"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", min_chars: int = 16, min_named: int = 6) -> DataFrame:
    """doc_id, path, pos (the word's number), candidate, word, before (three words), after."""
    got = docs.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    long = rf"{_KEY}{{{min_chars},}}"
    some = (F.col("text").rlike(long) & F.col("text").rlike("[0-9]")) | F.col("text").rlike(rf"{_NAMED}{_ASSIGN}{_KEY}{{{min_named},}}")
    got = got.where(some).select("doc_id", "path", F.split("text", r"\s+").alias("w"))
    pair = rf"{_NAMED}{_ASSIGN}({_KEY}{{{min_named},}})"

    def may_hold(x: Column, i: Column) -> Column:
        valued = x.rlike(rf"{_KEY}{{{min_named},}}") & (F.coalesce(F.get("w", i - 1).rlike(r"[=:>][\"'`(\[{]*$"), F.lit(False)) | x.rlike("^[=:]"))
        return (x.rlike(long) & x.rlike("[0-9]")) | x.rlike(pair) | valued

    words = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("pos"), F.when(may_hold(x, i), x).alias("word"))), lambda s: s["word"].isNotNull())
    got = got.select("doc_id", "path", "w", F.explode(words).alias("x")).select("doc_id", "path", "w", "x.pos", "x.word")
    got = got.withColumn("before", F.array_join(F.slice("w", F.greatest(F.col("pos") - 2, F.lit(1)), F.least(F.lit(3), F.col("pos"))), " ")).withColumn("after", F.coalesce(F.get("w", F.col("pos") + 1), F.lit(""))).drop("w")
    # the value of an assignment: the first run after the sign, whatever its length up to min_chars
    inside = F.regexp_extract_all("word", F.lit(pair), F.lit(1))
    across = F.when(F.col("before").rlike(rf"{_NAMED}{_ASSIGN}$"), F.regexp_extract("word", rf"^[\"'`(\[{{]*({_KEY}{{{min_named},}})", 1)).otherwise(F.lit(""))
    across = F.when((across == "") & F.col("before").rlike(rf"{_NAMED}[\"'`]?$"), F.regexp_extract("word", rf"^(?:=>|:=|[=:])[\"'`(\[{{]*({_KEY}{{{min_named},}})", 1)).otherwise(across)
    runs = F.filter(F.regexp_extract_all("word", F.lit(long), F.lit(0)), lambda x: x.rlike("[0-9]"))
    named = F.filter(F.concat(inside, F.array(across)), lambda x: (F.length(x) >= min_named) & ~F.exists(runs, lambda r: r.contains(x)))
    got = got.withColumn("candidate", F.explode(F.array_distinct(F.concat(runs, named))))
    return got.select("doc_id", "path", "pos", "candidate", "word", "before", "after")


def dictionary(docs: DataFrame, text_col: str = "text", per_million: float = 2.0) -> DataFrame:
    """word, n: the corpus's words of four or more letters that are at least ``per_million`` of a million of them, and occur twice at least."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text_col)), r"[^a-z]+")).alias("word")).where(F.length("word") >= 4)
    counted = materialize(words.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where((F.col("n") >= 2) & (F.col("n") * 1e6 >= per_million * total))


def letter_pairs(words: DataFrame) -> DataFrame:
    """One row: pairs, a map from two letters to the log2 of the second's probability after the first (at most 676 entries)."""
    pairs = words.where(F.length("word") >= 2).select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("pair"))
    counted = pairs.groupBy("pair").agg(F.sum("n").alias("n"))
    first = counted.groupBy(F.substring("pair", 1, 1).alias("a")).agg(F.sum("n").alias("of"))
    scored = counted.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("a"))
    return scored.agg(F.map_from_entries(F.collect_list(F.struct("pair", F.log2(F.col("n") / F.col("of")).alias("p")))).alias("pairs"))


def _share(c: Column, kind: str) -> Column:
    return F.regexp_count(c, F.lit(kind)) / F.length(c)


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """The candidates with FEATURES, and finding (their SHA-256)."""
    c = F.col("candidate")
    distinct = found.select("candidate").distinct()
    parts = distinct.select("candidate", F.explode(F.filter(F.split(F.lower("candidate"), "[^a-z]+"), lambda x: F.length(x) >= 4)).alias("word"))
    covered = parts.join(words.select("word"), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("in_words"))
    once = distinct.join(covered, "candidate", "left").crossJoin(F.broadcast(letter_pairs(words)))  # one row of at most 676 entries
    chars = F.split("candidate", "")
    letters = F.regexp_replace(F.lower("candidate"), "[^a-z]", "")
    pair_p = F.transform(F.sequence(F.lit(1), F.length("letters") - 1), lambda i: F.coalesce(F.element_at("pairs", F.substring("letters", i, F.lit(2))), F.lit(-12.0)))
    once = once.withColumn("letters", letters).withColumn("chars", chars)
    p = F.transform(F.array_distinct("chars"), lambda x: F.size(F.filter("chars", lambda y: y == x)) / F.size("chars"))
    once = once.select(
        "candidate",
        F.sha2("candidate", 256).alias("finding"),
        F.length(c).cast("double").alias("n_chars"),
        _share(c, "[0-9]").alias("digits"),
        _share(c, "[A-Z]").alias("uppers"),
        _share(c, "[a-z]").alias("lowers"),
        _share(c, "[^A-Za-z0-9]").alias("others"),
        F.aggregate(p, F.lit(0.0), lambda a, x: a - x * F.log2(x)).alias("entropy"),
        (F.regexp_count(c, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])")) / F.length(c)).alias("changes"),
        c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        F.when(F.length("letters") >= 2, F.aggregate(pair_p, F.lit(0.0), lambda a, x: a + x) / (F.length("letters") - 1)).otherwise(F.lit(-12.0)).alias("pair_logp"),
        (F.coalesce("in_words", F.lit(0)) / F.length(c)).alias("covered"),
    )
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    return found.join(once, "candidate").select(
        "doc_id",
        "path",
        "pos",
        "candidate",
        "before",
        "word",
        "finding",
        *[x for x in FEATURES if x in once.columns],
        path.rlike(EXAMPLES).cast("double").alias("in_examples"),
        F.size(F.split(path, "/")).cast("double").alias("path_depth"),
        (F.col("before").rlike(NAMES) | F.call_function("substring_index", F.col("word"), F.col("candidate"), F.lit(1)).rlike(NAMES)).cast("double").alias("named"),
        (F.col("before").rlike(r"[=:]\s*$") | F.call_function("substring_index", F.col("word"), F.col("candidate"), F.lit(1)).rlike("[=:]")).cast("double").alias("assigned"),
        F.col("word").rlike("[\"'`]").cast("double").alias("quoted"),
        F.col("after").rlike(r"^[A-Za-zÀ-ÿ]+[.,;]?$").cast("double").alias("next_word"),
    )


def stated_labels(rows: DataFrame) -> DataFrame:
    """finding, is_secret of the clear cases among ``featured`` rows; a finding that is clear both ways is left out."""
    c = F.col("candidate")
    placeholder = c.rlike(PLACEHOLDER) & (F.col("entropy") < 3.0)
    secret = (c.rlike(FORMATS) | ((F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("quoted") == 1) & (F.col("entropy") >= 3.0))) & ~placeholder
    false = placeholder | (F.col("digits") == 1) | (F.col("covered") >= 0.6) | ((F.col("entropy") < 2.5) & (F.col("named") == 0))
    labels = rows.select("finding", F.when(secret & ~false, True).when(false & ~secret, False).alias("is_secret")).where("is_secret IS NOT NULL")
    return labels.groupBy("finding").agg(F.min("is_secret").alias("low"), F.max("is_secret").alias("high")).where("low = high").select("finding", F.col("low").alias("is_secret"))


def fit_forest(rows: DataFrame, labels: DataFrame, max_rows: int = 100_000, trees: int = 30, depth: int = 6) -> RandomForestClassificationModel | None:
    """A forest fitted on labelled findings, ``max_rows`` at most (by a hash of the finding); None if they have one class only."""
    known = labels.where("finding IS NOT NULL AND is_secret IS NOT NULL").groupBy("finding").agg(F.max("is_secret").alias("is_secret"))
    total = known.count()
    if total > max_rows:
        known = known.where(F.pmod(F.xxhash64("finding", F.lit(5)), F.lit(1_000_000)) < int(1e6 * max_rows / total))
    train = rows.groupBy("finding").agg(*[F.max(x).alias(x) for x in FEATURES]).join(known, "finding").withColumn("label", F.col("is_secret").cast("double"))
    train = materialize(train.select("finding", "label", *FEATURES), "labelled-findings")
    if train.select("label").distinct().count() < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(train.orderBy("finding"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featureSubsetStrategy="sqrt").fit(vectors)


def scan_secrets(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", min_score: float = 0.5) -> DataFrame:
    """doc_id, path, pos, finding, n_chars, score, is_secret: one row for each candidate."""
    words = materialize(dictionary(docs, text_col), "dictionary")
    rows = materialize(featured(candidates(docs, id_col, text_col, path_col), words), "findings")
    stated = materialize(stated_labels(rows), "stated-labels")
    model = fit_forest(rows, stated if labels is None else labels)
    out = ["doc_id", "path", "pos", "finding", F.col("n_chars").cast("long").alias("n_chars")]
    if model is None:
        got = rows.join(stated, "finding", "left")
        return got.select(*out, F.lit(None).cast("double").alias("score"), F.coalesce("is_secret", F.lit(False)).alias("is_secret"))
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    return scored.withColumn("score", vector_to_array("probability")[1]).select(*out, F.round("score", 6).alias("score"), (F.col("score") >= min_score).alias("is_secret"))
