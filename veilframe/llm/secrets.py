"""Secrets in texts: candidates scored by a random forest trained on labelled findings.

A candidate is a run of ``RUN`` or more letters, digits and ``+/_-=`` inside a word, or, in a word without one, the whole value of ``SHORT`` or more
characters of any kind that follows a word of credentials and an assignment. Its features: length; mean log probability
of its character transitions and share of its letter triples that are common, both by the words of the whole corpus; shares of
digits and capitals, changes of character class, distinct characters; what stands around it (assignment, quotes, words of credentials or of checksums and
versions before it, signs of an address or a file path in its word); and whether the document's path speaks of tests or examples. A finding
whose probability is ``least`` or more is a secret, the rest are false alarms.

Labelled findings are a table (value, before, word, path, secret); ``labelled_findings`` makes one of bounded size from rules, for use where there
is none. Corpus counts come from all words and are two tables over letters (27 x 27 and 26^3), which go into the plan as
constants. Scanning is one pass over the texts without a shuffle. Everything runs in built-in functions and Spark's own learners.

Defined cases: null and empty texts have no candidates; a corpus without words makes all transitions equally likely; repeated rows are scanned one
by one; null paths say nothing; no documents give no findings; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.text import let
from veilframe.storage import materialize, new_path

RUN, SHORT, TREES, DEPTH, PER_KIND = 16, 6, 40, 8, 150
COMMON = 2e-5  # a letter triple is common from this share of all triples on
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
# Words that go before credentials, and before values that look like them.
CREDENTIAL = r"(?i)(token|secret|passw|pwd|api.?key|access.?key|private|auth|bearer|credential)"
BENIGN = r"(?i)(commit|sha\d*|md5|checksum|uuid|guid|digest|hash|revision|version|order|image|integrity|etag)"
# what stands between the credential word and a value, and the value inside its word
ASSIGNED = r"(?i)(token|secret|passw\w*|pwd|key|auth|bearer|credentials?)[\"'`]?\s*[=:]+>?\s*$"
VALUE = r"^(?>(?:[^=:\"'`]*[=:]+)?)[\"'`]?([^\"'`]{5,}?[^\"'`=:,;.)}\]])[\"'`]?[,;.)}\]]*$"
TESTING = r"(?i)(test|example|sample|mock|fixture|dummy)"
FEATURES = ["size", "transitions", "coverage", "digits", "capitals", "changes", "distinct", "assigned", "quoted", "credential", "benign", "address", "testing"]


def corpus_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """(piece, n): letter pairs (with _ for a word's ends) and triples over all words of ASCII letters."""
    all_words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z]+")
    counts = docs.select(F.explode(all_words).alias("w")).where(F.col("w") != "").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    framed = counts.select("n", F.concat(F.lit("_"), "w", F.lit("_")).alias("f"), "w")
    pairs = F.transform(F.sequence(F.lit(1), F.length("f") - 1), lambda i: F.substring("f", i, 2))
    triples = F.when(F.length("w") > 2, F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, 3))).otherwise(F.array().cast("array<string>"))
    return framed.select("n", F.explode(F.concat(pairs, triples)).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))


class Letters:
    """Log probabilities of transitions and the common triples, as constant columns; at most 18,305 numbers whatever the corpus."""

    def __init__(self, pieces: dict[str, int]):
        pairs = {p: n for p, n in pieces.items() if len(p) == 2}
        triples = {p: n for p, n in pieces.items() if len(p) == 3}
        alphabet = "_abcdefghijklmnopqrstuvwxyz"
        after = {a: sum(pairs.get(a + b, 0) for b in alphabet) for a in alphabet}
        logs = [math.log((pairs.get(a + b, 0) + 0.1) / (after[a] + 2.7)) for a in alphabet for b in alphabet]
        total = sum(triples.values())
        common = "".join("1" if triples.get(a + b + c, 0) > COMMON * total else "0" for a in alphabet[1:] for b in alphabet[1:] for c in alphabet[1:])
        self.logs = F.split(F.lit(" ".join(map(str, logs))), " ").cast("array<double>")
        self.common = F.lit(common)

    def transitions(self, value: Column) -> Column:
        """Mean log probability of a transition; everything but letters counts as a word's end."""
        codes = F.transform(F.split(F.lower(value), ""), lambda c: F.when(c.rlike("^[a-z]$"), F.ascii(c) - 96).otherwise(0))
        mean = lambda x: F.aggregate(F.sequence(F.lit(1), F.size(x) - 1), F.lit(0.0), lambda s, i: s + F.get(self.logs, F.get(x, i - 1) * 27 + F.get(x, i))) / (F.size(x) - 1)
        return let(codes, mean)

    def coverage(self, value: Column) -> Column:
        """Share of the value's places where a common triple of letters starts."""
        codes = F.transform(F.split(F.lower(value), ""), lambda c: F.when(c.rlike("^[a-z]$"), F.ascii(c) - 97).otherwise(-1))

        def share(x):
            at = lambda i: F.get(x, i - 1) * 676 + F.get(x, i) * 26 + F.get(x, i + 1)
            hit = lambda i: (F.get(x, i - 1) >= 0) & (F.get(x, i) >= 0) & (F.get(x, i + 1) >= 0) & (F.substr(self.common, at(i) + 1, F.lit(1)) == "1")
            return F.size(F.filter(F.sequence(F.lit(1), F.size(x) - 2), hit)) / (F.size(x) - 2)

        return let(codes, share)


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def with_features(rows: DataFrame, letters: Letters) -> DataFrame:
    """``rows`` (value, before, word, path) with a column for every feature; ``before`` is the two words before."""
    v, before, word = F.col("value"), F.concat(F.coalesce("before", F.lit("")), F.lit(" "), "word"), F.col("word")
    lead = F.concat(F.coalesce("before", F.lit("")), F.lit(" "), F.expr("substring(word, 1, instr(word, value) - 1)"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return rows.withColumns(
        {
            "size": F.least(F.length(v), F.lit(200)).cast("double"),
            "transitions": letters.transitions(v),
            "coverage": letters.coverage(v),
            "digits": _share(v, "[0-9]"),
            "capitals": _share(v, "[A-Z]"),
            "changes": _share(v, "(?<=[A-Z])[a-z](?=[A-Z0-9])|(?<=[a-zA-Z])[0-9]|(?<=[0-9])[a-zA-Z]|(?<=[a-z])[A-Z]"),
            "distinct": F.size(F.array_distinct(F.split(F.lower(v), ""))) / F.least(F.length(v), F.lit(32)),
            "assigned": yes(lead.rlike(r"[=:]\s*[\"'`]?$")),
            "quoted": yes(lead.rlike(r"[\"'`]$")),
            "credential": yes(before.rlike(CREDENTIAL)),
            "benign": yes(lead.rlike(BENIGN)),
            "address": yes(word.rlike(r"://|[a-z]@[a-z]|\.(com|org|net|edu|gov|io|py|js|md|txt|html?|json|ya?ml|toml|png|jpe?g|[a-z]{2})\b|/[a-z]+/|base64,")),
            "testing": yes(F.col("path").rlike(TESTING)),
        }
    )


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """(doc_id, nr, value, before, word, path): every candidate of the whole texts; ``nr`` is its word, from 0."""
    place = F.col(path).cast("string") if path else F.lit(None).cast("string")
    split = docs.select(F.col(key).alias("doc_id"), F.split(F.coalesce(F.col(text), F.lit("")), r"[ \t\r\n]+").alias("words"), place.alias("path"))
    near = lambda i: F.concat_ws(" ", F.get("words", i - 2), F.get("words", i - 1))
    lead = lambda w, i: F.concat(near(i), F.lit(" "), F.regexp_extract(w, "^[^=:]*[=:]+", 0))
    short = lambda w, i: (F.length(w) >= SHORT) & (F.length(w) < 256) & lead(w, i).rlike(ASSIGNED)
    # the words before are only looked at where one of them, or the word itself, has an assignment
    assigned = lambda w, i: F.when(w.contains("=") | w.contains(":") | F.get("words", i - 1).rlike("[=:]>?$"), short(w, i)).otherwise(False)
    at = F.filter(F.transform("words", lambda w, i: F.when((F.length(w) >= RUN) | ((F.length(w) >= SHORT) & assigned(w, i)), i)), lambda i: i.isNotNull())
    found = split.select("doc_id", "path", "words", F.explode(at).alias("nr"))
    rows = found.select("doc_id", "nr", F.get("words", F.col("nr")).alias("word"), near(F.col("nr")).alias("before"), "path")
    runs = F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))
    own = F.regexp_extract("word", VALUE, 1)
    lead_of = F.concat("before", F.lit(" "), F.regexp_extract("word", "^[^=:]*[=:]+", 0))
    whole = F.when(lead_of.rlike(ASSIGNED) & (own != ""), F.array(own)).otherwise(F.array().cast("array<string>"))
    return rows.select("doc_id", "nr", F.explode(F.when(F.size(runs) > 0, runs).otherwise(whole)).alias("value"), "before", "word", "path")


def labelled_findings(spark: SparkSession, per_kind: int = PER_KIND) -> DataFrame:
    """(value, before, word, path, secret): ``per_kind`` findings of each of the kinds below, made from hashes of their numbers."""
    n = F.col("i")
    hexes = lambda size: F.substring(F.sha2(F.concat(F.lit("x"), n), 512), 1, size)
    b64 = lambda size: F.substring(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), n), 512))), "+/=", "aZ9"), 1, size)
    pick = lambda options, salt: F.get(F.array(*map(F.lit, options)), F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(len(options))).cast("int"))
    cased = lambda c: F.when(n % 7 == 0, F.upper(c)).otherwise(c)
    names = ["token =", "secret =", "api_key:", "password =", "the token =", "auth_token:", "access_key =", "Bearer token:", "of TOKEN ="]
    plain = ["and the", "of an", "then, he", "in that", "der und", "de la", "que los", "", "was so.", "a b"]
    sums = ["commit id", "sha256 =", "md5:", "checksum =", "uuid:", "image digest:", "git revision", "etag:", "hash ="]
    syllable = lambda k: pick(["th", "er", "ing", "on", "re", "in", "at", "nd", "st", "sh", "ou", "tion", "ed", "ver", "keit", "ment", "eau", "os", "ble", "ly"], f"s{k}")
    word = lambda size: F.concat(*[syllable(k) for k in range(size)])
    uuid = F.concat_ws("-", *[F.substring(hexes(40), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    sign = pick(["!", "@", "#", "$", "%", "&", "*", "?", ".", "-"], "g")
    digit = lambda salt: F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(1000)).cast("string")
    mixed = F.concat(F.substring(b64(40), 3, 3), sign, F.substring(b64(40), 9, 4), digit("d"))
    leet = F.concat(F.initcap(F.translate(word(3), "oeas", "0345")), digit("e"), sign, F.substring(b64(40), 20, 2))
    asks = ["password =", "pwd:", "passwd:", "secret =", "the password:", "api_key =", "token:"]
    fillers = ["changeme", "required", "password", "<password>", "********", "undefined", "optional", "missing", "string", "{password}", "$PASSWORD", "xxxxxxxx", "example", "your-password"]
    digits = F.substring(F.translate(hexes(64), "abcdef", "123456"), 1, 16)
    kinds = [
        (1, cased(hexes(40)), names), (1, cased(hexes(32)), names), (1, hexes(64), names), (1, b64(40), names), (1, b64(32), names), (1, b64(64), names), (1, hexes(40), names),
        (1, F.concat(F.lit("AKIA"), F.upper(b64(16))), plain + names), (1, F.concat(F.lit("ghp_"), b64(36)), plain + names), (1, F.concat(F.lit("sk_live_"), b64(24)), plain + names), (1, b64(20), ["password =", "passwd:", "pwd ="]),
        (0, hexes(40), sums), (0, hexes(64), sums), (0, hexes(32), sums), (0, uuid, plain + sums), (0, digits, plain + ["order id", "phone:", "card"]),
        (0, cased(word(6)), plain), (0, cased(word(8)), plain), (0, cased(word(12)), plain), (0, F.concat(word(3), F.lit("-"), F.initcap(word(4))), plain), (0, word(9), names), (0, F.concat(F.initcap(word(3)), F.initcap(word(3)), F.initcap(word(2))), plain + names),
        (0, F.repeat(pick(["x", "0", "a", "1", "X"], "r"), 24), names), (0, F.concat(F.lit("your-"), pick(["api-key", "token", "secret"], "y"), F.lit("-goes-here")), names), (0, F.repeat(pick(["=", "-", "_", "=-"], "l"), 20), plain),
        (1, mixed, asks), (1, leet, asks), (1, F.concat(word(2), digit("f"), sign, F.substring(b64(40), 5, 1)), asks), (1, F.substring(b64(40), 1, 12), asks), (1, F.substring(hexes(40), 1, 10), asks),
        (0, pick(fillers, "z"), asks), (0, word(3), asks), (0, F.initcap(word(4)), asks), (0, F.concat(word(2), F.lit("_"), word(2)), asks), (0, F.concat(word(2), F.lit("."), word(2), F.lit("()")), asks),
        (0, F.concat(word(5), F.lit("-"), word(3)), plain + names, "https://www.site.com/a/"), (0, F.concat(word(4), F.lit("_"), word(4)), plain, "docs/guide/"),
    ]
    every = None
    for k, (secret, value, leads, *prefix) in enumerate(kinds):
        quote = F.when(n % 3 > 0, F.lit('"')).otherwise(F.lit(""))
        tail = pick(["", "", ",", ".", "!!", "###", "***"], "t")
        i = (F.col("id") + k * 1_000_003).alias("i")
        # two rows of three have a path that says nothing about the label
        path = F.when(n % 3 < 2, pick(["src0", "a/b.py", "tests/x.py", "examples/y.md"], "p")).otherwise("src0" if secret else "tests/x.py")
        rows = spark.range(per_kind).select(i).select("i", value.alias("value"), path.alias("path"), pick(leads, "n").alias("before"), quote.alias("q"), tail.alias("t"))
        rows = rows.select("value", "before", F.concat("q", F.lit("".join(prefix)), "value", "q", "t").alias("word"), "path", F.lit(secret).alias("secret"))
        every = rows if every is None else every.unionByName(rows)
    return every


def train(findings: DataFrame, letters: Letters, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """A forest over the findings' features; ``findings`` are labelled rows of bounded number."""
    # written first, so that the features are compiled once and not once per part of a union
    written = materialize(findings.coalesce(4), "findings")
    rows = materialize(with_features(written, letters).select(*FEATURES, F.col("secret").cast("double").alias("label")), "features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, featuresCol="features", labelCol="label")
    path = new_path(findings.sparkSession, "forest")
    Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(rows).write().save(path)
    return PipelineModel.load(path)  # without the training summary, which cannot go to tasks


def judge(rows: DataFrame, letters: Letters, model: PipelineModel) -> DataFrame:
    """Candidates with the probability that they are secrets."""
    scored = model.transform(with_features(rows, letters))
    return scored.select(*rows.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("probability"))


def find_secrets(docs: DataFrame, letters: Letters, model: PipelineModel, least: float = 0.5, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """doc_id, nr, value, before, word, path, probability of every secret."""
    return judge(candidates(docs, key, text, path), letters, model).where(F.col("probability") >= least)


def learn_letters(docs: DataFrame, text: str = "text") -> Letters:
    return Letters({r.piece: r.n for r in corpus_letters(docs, text).collect()})  # at most 27 x 27 + 26^3 pieces
