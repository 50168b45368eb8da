"""Secret scans: candidates by pattern, false alarms removed by a random forest.

Candidates are values given to the name of a credential, of four characters or
more (eight for tokens and keys) whatever they consist of, bearer tokens, heads
of private keys, and every long run of key characters, vendors' keys among them.
An unquoted value ends before closing punctuation. The forest sees its length,
the mix and transitions of its characters, how much of it dictionary words
cover, the path it stands in and the words beside it, and is trained on
labelled findings. Everything runs in SQL expressions and Spark's own learner.

Labels come with the caller (``fit(..., labels)``). Without any,
``distant_labels`` names clear cases by any of several rules: a quoted value
assigned to the name of a credential, a bare one of letters and digits, a bearer
token of both, a vendor's key or the head of a private key, wherever they stand,
is a finding; a value without digits, or of digits alone, or marked as an
example, is a false alarm; the rest, and what is both, is unlabelled.

Defined results: a null text holds no candidates, a null path is empty. Equal
candidates at different places are scored each. Without findings of both kinds
every candidate's score is the share of true ones, 0.5 if none is labelled. An
empty table gives an empty table. Extra columns are ignored. Texts are searched
whole, in time that grows with their length.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findling.functions.arrays import running_before
from findling.session import written

CONTEXT = 48  # characters kept on either side of a candidate
WORD = r"[a-z]{3,}"
COMMON = 20  # occurrences in all texts from which a word is in the dictionary
SAMPLE = 20_000  # labelled findings the forest is fitted on, half of each kind at most
TREES = 20
DEPTH = 6
THRESHOLD = 0.5

#: Names that a credential is given; fixed values.
PASSWORD_NAMES = "secret|passw|pwd|credential"
TOKEN_NAMES = "token|api[_-]?key|access[_-]?key|private[_-]?key|auth(?!ors?[^a-z])|bearer"
KEY_NAMES = f"{PASSWORD_NAMES}|{TOKEN_NAMES}"

#: Patterns that Java and Python read alike.
RUN = r"[A-Za-z0-9+/_\-]"
BARE = r"""[^ \t\r\n"]"""
LAST = r"""[^ \t\r\n".,;)\]}>]"""
PEM = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
BEARER = r"(?<![A-Za-z0-9])(?i:bearer)[ \t]+"


def _given_to(names: str) -> str:
    """The whole run that holds one of ``names``, and what assigns a value to it."""
    # The names are looked for once, at the head of the run, which is then taken whole and not
    # given back: a run of any length costs its length.
    return rf"""(?<!{RUN})(?={RUN}*(?i:{names})){RUN}++["']?[ \t\r\n]*(?:=>|:=|={{1,3}}|:)[ \t\r\n]*"""


def _value(least: int) -> str:
    return rf"""(?:"[^"\n]{{{least},}}"|'[^'\n]{{{least},}}'|{BARE}{{{least - 1},}}{LAST})"""


CANDIDATE = "|".join([
    _given_to(PASSWORD_NAMES) + _value(4),
    _given_to(TOKEN_NAMES) + _value(8),
    BEARER + r"[A-Za-z0-9._~+/=\-]{7,}[A-Za-z0-9_~+/=\-]",
    PEM,
    RUN + "{16,}",
])
#: What stands before the value within a candidate's match.
LEAD = rf"""^(?:{_given_to(KEY_NAMES)}["']?|{BEARER})"""
VENDOR = f"^(sk-[A-Za-z0-9_-]{{16,}}|gh[pousr]_[A-Za-z0-9]{{20,}}|AKIA[A-Z0-9]{{16}}|{PEM})$"
#: Words beside values that are no secrets; fixed values.
HARMLESS = "example|sample|dummy|placeholder|checksum|digest|sha1|sha256|md5|commit|uuid|hash"
TEST_PATHS = "test|spec|fixture|example|mock|docs?/"

FEATURES = {
    "n_chars": "length(value)",
    "digits": "regexp_count(value, '[0-9]') / length(value)",
    "upper": "regexp_count(value, '[A-Z]') / length(value)",
    "lower": "regexp_count(value, '[a-z]') / length(value)",
    "marks": "regexp_count(value, '[-+/_]') / length(value)",
    "blanks": "regexp_count(value, ' ') / length(value)",
    "other_marks": "regexp_count(value, '[^-A-Za-z0-9+/_ ]') / length(value)",
    "hex_only": "int(value rlike '^([0-9a-f]+|[0-9A-F]+)$')",
    "distinct": "size(array_distinct(split(value, ''))) / length(value)",
    "letter_digit": "regexp_count(value, '[A-Za-z](?=[0-9])') / length(value)",
    "digit_letter": "regexp_count(value, '[0-9](?=[A-Za-z])') / length(value)",
    "lower_upper": "regexp_count(value, '[a-z](?=[A-Z])') / length(value)",
    "upper_lower": "regexp_count(value, '[A-Z](?=[a-z])') / length(value)",
    "same_twice": "regexp_count(value, '(.)(?=\\\\1)') / length(value)",
    "vowel_consonant": "regexp_count(lower(value), '[aeiou](?=[b-df-hj-np-tv-z])') / length(value)",
    "longest_word": "array_max(transform(split(value, '[^A-Za-z]+'), x -> length(x)))",
    "coverage": "coverage",
    "slashes": "regexp_count(value, '/')",
    "in_url": "int(before rlike '(?i)(https?://|www[.])[^ ]*$')",
    "file_ending": "int(after rlike '^[.][A-Za-z]{1,4}([^A-Za-z]|$)')",
    "test_path": f"int(lower(path) rlike '{TEST_PATHS}')",
    "path_depth": "regexp_count(path, '/')",
    "key_beside": f"int(lower(before) rlike '({KEY_NAMES})[a-z_]*[^a-z]*$')",
    "key_near": f"int(lower(before) rlike '{KEY_NAMES}')",
    "assigned": "int(before rlike '[:=] *[^A-Za-z0-9 ]?$')",
    "quoted": "int(before rlike '[\"\\']$' AND after rlike '^[\"\\']')",
    "harmless_near": f"int(lower(concat(before, ' ', after)) rlike '{HARMLESS}')",
}


def candidates(docs: DataFrame, path: Column) -> DataFrame:
    """``doc_id, at, value, before, after, path`` of every candidate in whole texts.

    ``at`` counts characters from 0. Texts are neither shuffled nor split into rows.
    """
    found = (
        docs.select("doc_id", F.coalesce(path.cast("string"), F.lit("")).alias("path"), "text")
        .filter(F.col("text").rlike(CANDIDATE))
        .select(
            "doc_id",
            "path",
            F.regexp_extract_all("text", F.lit(f"({CANDIDATE})")).alias("found"),
            F.split("text", CANDIDATE, -1).alias("rest"),
        )
    )
    lead = F.transform("found", lambda m: F.regexp_extract(m, LEAD, 0))
    closing = """transform(found, (m, i) -> int(right(lead[i], 1) IN ('"', "'") AND length(m) > length(lead[i])
        AND right(m, 1) = right(lead[i], 1)))"""
    gaps = "transform(found, (v, i) -> length(rest[i]) + CASE WHEN i > 0 THEN length(found[i - 1]) ELSE 0 END)"
    # What stands before the gaps of earlier candidates, and this one's own gap.
    ends = f"zip_with({running_before('gaps')}, gaps, (a, b) -> a + b)"
    each = f"""transform(found, (v, i) -> struct(ends[i] + length(lead[i]) AS at,
        substring(v, length(lead[i]) + 1, length(v) - length(lead[i]) - closing[i]) AS value,
        right(concat(right(rest[i], {CONTEXT}), lead[i]), {CONTEXT}) AS before,
        left(concat(right(v, closing[i]), left(rest[i + 1], {CONTEXT})), {CONTEXT}) AS after))"""
    return (
        found.withColumn("lead", lead)
        .withColumn("closing", F.expr(closing))
        .withColumn("gaps", F.expr(gaps))
        .withColumn("ends", F.expr(ends))
        .select("doc_id", "path", F.explode(F.expr(each)).alias("c"))
        .select("doc_id", "c.at", "c.value", "c.before", "c.after", "path")
    )


def dictionary(docs: DataFrame, least: int = COMMON) -> DataFrame:
    """``word``: words of letters that occur ``least`` times or more in all texts."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"({WORD})")))
    return docs.select(words.alias("word")).groupBy("word").count().filter(
        F.col("count") >= least
    ).select("word")


def with_coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with ``coverage``: the share of a value's characters in dictionary words.

    Values are cut at marks, digits and capitals; each distinct value is looked up once.
    """
    cut = F.regexp_replace("value", r"([a-z])([A-Z])", "$1 $2")
    parts = F.explode(F.regexp_extract_all(F.lower(cut), F.lit(rf"({WORD})")))
    values = found.select("value").distinct()
    covered = (
        values.select("value", parts.alias("word"))
        .join(words, "word")
        .groupBy("value")
        .agg((F.sum(F.length("word")) / F.length("value")).alias("coverage"))
    )
    return found.join(covered, "value", "left").withColumn(
        "coverage", F.coalesce("coverage", F.lit(0.0))
    )


def featured(found: DataFrame) -> DataFrame:
    """The columns of ``found`` and ``features``, a vector."""
    numbers = [F.expr(f"double({e})").alias(f"__{name}") for name, e in FEATURES.items()]
    names = [f"__{name}" for name in FEATURES]
    assembled = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return assembled.transform(found.select("*", *numbers)).drop(*names)


def distant_labels(found: DataFrame) -> DataFrame:
    """``found`` with ``label``: 1, 0, or null where the case is not clear."""
    named = f"{FEATURES['key_beside']} = 1 AND {FEATURES['assigned']} = 1"
    mixed = "value rlike '[0-9]' AND value rlike '[A-Za-z]'"
    secret = (
        F.expr(f"({named} AND {FEATURES['quoted']} = 1) OR ({named} AND {mixed})")
        | F.expr(f"before rlike '(?i)bearer[ \\\\t]+$' AND {mixed}")
        | F.col("value").rlike(VENDOR)
    )
    harmless = F.expr(
        f"value rlike '^[A-Za-z]+$' OR value rlike '^[0-9]+$' OR {FEATURES['harmless_near']} = 1"
    )
    return found.withColumn(
        "label",
        F.when(secret & ~harmless, 1.0).when(harmless & ~secret, 0.0).cast("double"),
    )


def fit(labelled: DataFrame):
    """A forest fitted on a bounded hash sample of rows with ``features`` and ``label``, or
    the share of true findings when there is nothing to tell apart."""
    known = labelled.filter(F.col("label").isin(0.0, 1.0))
    counts = {int(r["label"]): r["count"] for r in known.groupBy("label").count().collect()}
    if len(counts) < 2:
        return 1.0 if 1 in counts else 0.0 if counts else 0.5
    coin = F.pmod(F.xxhash64("doc_id", "at", "value"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = {k: min(1.0, SAMPLE / 2 / n) for k, n in counts.items()}
    sample = known.filter(
        coin < F.when(F.col("label") == 1.0, F.lit(share[1])).otherwise(F.lit(share[0]))
    )
    sample = written(sample.select("features", "label"), "labelled-findings")
    if sample.select("label").distinct().count() < 2:
        return counts[1] / (counts[0] + counts[1])
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=17, cacheNodeIds=False)
    return forest.fit(sample)


def score(rows: DataFrame, model) -> DataFrame:
    """``rows`` with ``score``, the forest's probability of a true finding."""
    if isinstance(model, float):
        return rows.withColumn("score", F.lit(model))
    voted = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return voted.drop("rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, path: Column, labels: DataFrame | None = None) -> DataFrame:
    """All candidates of ``docs`` with ``score`` and ``is_secret``.

    ``labels`` holds ``value, label`` of reviewed findings; without it the clear
    cases are labelled by their company.
    """
    found = written(candidates(docs, path), "candidates")
    covered = featured(with_coverage(found, written(dictionary(docs), "dictionary")))
    rows = written(covered, "findings")
    if labels is None:
        labelled = distant_labels(rows)
    else:
        reviewed = labels.groupBy("value").agg(F.max("label").cast("double").alias("label"))
        labelled = rows.join(reviewed, "value")
    scored = score(rows, fit(labelled))
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD).drop("features")


def report(docs: DataFrame, path: Column) -> DataFrame:
    """Candidates without the secret itself: its digest and first characters stand for it,
    a quarter of a short one at most."""
    return scan(docs, path).select(
        "doc_id",
        "at",
        F.length("value").alias("n_chars"),
        F.expr("concat(left(value, least(4, length(value) div 4)), '...')").alias("masked"),
        F.sha2("value", 256).alias("value_sha256"),
        "coverage",
        "score",
        "is_secret",
    )
