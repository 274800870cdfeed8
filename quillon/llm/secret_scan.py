"""Secret scans: key-like strings, judged by a random forest.

Candidates are runs of 16 or more key characters, the padding at their end
counted; shorter strings are words more often than keys and aren't judged. Features of a candidate and of its neighbourhood in the text, which
may hold other candidates, are column expressions; a random forest (Spark ML, in the
JVM), trained on labelled findings, tells secrets from look-alikes such as
checksums, identifiers, long words, paths and placeholders. One map stage over
the texts: nothing is shuffled but the training rows.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import let

#: Runs of key characters, with ``=`` as padding at the end only; ``+`` after the counts keeps the search linear.
PADDING = "={1,6}+(?![A-Za-z0-9_+/=-])"
CANDIDATE = rf"(?<![A-Za-z0-9_+/-])(?:[A-Za-z0-9_+/-]{{16,}}+(?:{PADDING})?|(?=[A-Za-z0-9_+/=-]{{16}})[A-Za-z0-9_+/-]{{10,15}}+{PADDING})"
#: Characters of context before and after a candidate.
BEFORE, AFTER = 48, 24
#: Words that stand next to secrets, and next to look-alikes.
SECRET_WORDS = "token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private.?key|signature"
OTHER_WORDS = "sha1|sha256|md5|checksum|commit|digest|uuid|guid|revision|etag|image|build|example|sample|dummy|placeholder"
#: Dictionary for the coverage of a candidate: frequent words and word parts.
DICTIONARY = (
    "about after again also and any are back because been before being between both but can come could day did down each even "
    "example file find first for from get good great had has have here high home how into just key know large last life like line "
    "little long look made make man many may more most much must name never new not now number off old one only other our out over "
    "own part people place right said same school see should show small some sound still such take than that the their them then "
    "there these they thing think this those thought three through time too tree two under use very want was water way well were "
    "what when where which while who why will with word work world would year you your password secret token user admin test data "
    "value config server client index page image static assets ation tion ing ness ment able ible ous ent ant er on in re"
).split()
FEATURES = ("length", "digits", "uppers", "lowers", "hexadecimal", "transitions", "distinct", "repeats", "coverage", "path", "dashes", "assigned", "quoted", "secret_word", "other_word", "known_form", "digits_only")
#: Forms of keys that are known by their beginning.
KNOWN = r"^(AKIA[0-9A-Z]{16}$|gh[pousr]_|xox[abprs]-|sk[-_](live|test|proj)?|AIza|eyJ[A-Za-z0-9_-]{10,}|glpat-|npm_)"


def with_features(found: DataFrame) -> DataFrame:
    """Adds :data:`FEATURES` to rows of ``candidate``, ``before`` and ``after``."""
    c, n = F.col("candidate"), F.length("candidate")
    before, low = F.lower("before"), F.lower("candidate")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    flag = lambda condition: F.when(condition, 1.0).otherwise(0.0)
    # Words and parts of three letters and more count; longer ones are tried first.
    parts = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    each = {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "hexadecimal": flag(c.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "transitions": F.regexp_count(c, F.lit("(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Z])(?=[a-z])")) / (n - 1),
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "repeats": flag(c.rlike(r"(.)\1{3,}|(0123|1234|abcd|ABCD)")),
        "coverage": 1 - F.length(F.regexp_replace(low, parts, "")) / n,
        "path": share("/") + flag(F.col("before").rlike(r"(https?:/{0,2}|[\w.]/)\S*$")),
        "dashes": share("[-_]"),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$")),
        "secret_word": flag(F.concat(before, F.lit(" "), low).rlike(SECRET_WORDS)),
        "other_word": flag(F.concat_ws(" ", before, low, F.lower("after")).rlike(OTHER_WORDS)),
        "known_form": flag(c.rlike(KNOWN)),
        "digits_only": flag(c.rlike("^[0-9_=+/-]+$")),
    }
    return found.withColumns(each)


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(``id_col``, ``start``, ``candidate``, ``before``, ``after``) for each candidate; starts count characters from 0."""
    hits = docs.select(id_col, text, F.regexp_extract_all(text, F.lit(CANDIDATE), 0).alias("_hits")).where(F.size("_hits") > 0)
    # Hit k lies between pieces k and k + 1.
    apart = hits.select(id_col, "_hits", F.split(text, CANDIDATE, -1).alias("_pieces"))
    # The text around a hit is of pieces and of other hits, each of which has 16 characters or more.
    last = lambda xs, k: F.right(F.get(xs, k), F.lit(BEFORE))
    first = lambda xs, k: F.left(F.get(xs, k), F.lit(AFTER))
    back, ahead = -(-BEFORE // 16), -(-AFTER // 16)
    before = lambda k: F.right(F.concat_ws("", *[x for j in range(back, 0, -1) for x in (last("_hits", k - j), last("_pieces", k - j + 1))]), F.lit(BEFORE))
    after = lambda k: F.left(F.concat_ws("", *[x for j in range(1, ahead + 1) for x in (first("_pieces", k + j), first("_hits", k + j))]), F.lit(AFTER))
    steps = F.zip_with("_pieces", "_hits", lambda p, h: F.length(p) + F.coalesce(F.length(h), F.lit(0)))

    def each(starts: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size("_hits") - 1),
            lambda k: F.struct((F.get(starts, k) + F.length(F.get("_pieces", k))).alias("start"), F.get("_hits", k).alias("candidate"), before(k).alias("before"), after(k).alias("after")),
        )

    found = apart.select(id_col, F.explode(let(steps, lambda s: let(sums_before(s), each))).alias("_x"))
    return found.select(id_col, F.col("_x.start").cast("long").alias("start"), "_x.candidate", "_x.before", "_x.after")


def sums_before(xs: Column) -> Column:
    """For each place of an array the sum of all before it, by blocks of its size's root: n * sqrt(n) additions."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    block = F.ceil(F.sqrt(F.size(xs))).cast("int")
    places = lambda n: F.sequence(F.lit(0), n - 1)
    blocks = F.transform(places(block), lambda j: total(F.slice(xs, j * block + 1, block)))
    inner = lambda k: total(F.slice(xs, k - k % block + 1, k % block))
    heads = lambda sums: F.transform(places(block), lambda j: total(F.slice(sums, F.lit(1), j)))
    at = lambda starts: F.transform(places(F.size(xs)), lambda k: F.get(starts, (k / block).cast("int")) + inner(k))
    return let(blocks, lambda sums: let(heads(sums), at))


def labelled_findings(spark: SparkSession, n: int = 6000, seed: int = 5) -> DataFrame:
    """Labelled findings by rule: (``candidate``, ``before``, ``after``, ``label``), label 1 for secrets.

    For those who have none of their own. Strings and contexts follow a hash of
    the row's number, so that any two calls give the same rows.
    """
    key = lambda salt: F.sha2(F.concat_ws(":", F.lit(f"{seed}.{salt}"), F.col("id").cast("string")), 256)
    pick = lambda salt, options: F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(f"{seed}.{salt}"), "id"), F.lit(len(options))) + 1).cast("int"))
    b64 = F.regexp_replace(F.base64(F.unhex(F.concat(key("b"), key("c")))), r"[\s]", "")
    join = pick("j", ["", "", "_", "-", "/"])
    words = F.array_join(F.array(*[pick(f"w{k}", DICTIONARY) for k in range(8)]), "~")
    words = F.replace(words, F.lit("~"), join)
    secret_before = ['token = "', "token: ", "api_key = '", "API_KEY=", "password=", "Authorization: Bearer ", "secret_key: ", 'client_secret = "', "access_key ", 'the token "', "TOKEN = \"", "credential=", "auth: "]
    plain_before = ["the ", "of this ", "and ", "was ", "", "in the ", "see ", " | "]
    hash_before = ["commit ", "sha1: ", "md5 = ", "checksum: ", "digest ", "revision ", "etag: \"", "sha256:", "build "]
    real = F.element_at(
        F.array(F.left(key("a"), F.lit(40)), F.left(key("a"), F.lit(40)), F.upper(F.left(key("a"), F.lit(40))), F.left(key("a"), F.lit(32)), F.left(b64, F.lit(40)), F.left(b64, F.lit(24)), F.concat(F.lit("AKIA"), F.upper(F.left(key("a"), F.lit(16)))), F.concat(F.lit("ghp_"), F.left(F.regexp_replace(b64, "[+/=]", "x"), F.lit(36)))),
        (F.pmod(F.xxhash64(F.lit("real"), "id"), F.lit(8)) + 1).cast("int"),
    )
    digits = F.left(F.regexp_replace(F.concat(key("d"), key("e")), "[a-f]", ""), F.lit(16))
    uuid = F.regexp_replace(F.left(key("u"), F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    other = F.array(
        F.struct(words.alias("c"), pick("p", plain_before + secret_before[:4]).alias("b")),
        F.struct(F.concat(words, pick("x", ["index", "image12", "file2024", "page3"])).alias("c"), pick("q", ["https://www.", "/usr/", "./", "http://", "the "]).alias("b")),
        F.struct(F.left(key("h"), pick("l", ["40", "32", "64"]).cast("int")).alias("c"), pick("r", hash_before).alias("b")),
        F.struct(digits.alias("c"), pick("s", plain_before + ["call ", "no. ", "card "]).alias("b")),
        F.struct(uuid.alias("c"), pick("t", ["uuid: ", "guid=", "id ", "request "]).alias("b")),
        F.struct(pick("v", ["xxxxxxxxxxxxxxxxxxxx", "your_api_key_here", "0000000000000000", "1234567890123456", "aaaaaaaaaaaaaaaaaaaaaaaa", "EXAMPLE_TOKEN_VALUE", "----------------", "================", "________________"]).alias("c"), pick("y", secret_before + plain_before).alias("b")),
        F.struct(F.regexp_replace(F.left(F.concat(words, words), F.lit(24)), "[^a-z]", "e").alias("c"), pick("z", plain_before).alias("b")),
        F.struct(F.translate(F.left(key("m"), F.lit(20)), "0123456789", "aeiourstln").alias("c"), pick("n", plain_before).alias("b")),
    )
    rows = spark.range(0, n, 1, 1).withColumn("label", F.when(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(5)) < 2, 1.0).otherwise(0.0))
    chosen = F.element_at(other, (F.pmod(F.xxhash64(F.lit("other"), "id"), F.lit(8)) + 1).cast("int"))
    rows = rows.select("label", F.when(F.col("label") == 1, F.struct(real.alias("c"), pick("g", secret_before).alias("b"))).otherwise(chosen).alias("x"), pick("f", ["\"", "'", " ", "\n", "\" the", " and"]).alias("after"))
    return rows.select(F.col("x.c").alias("candidate"), F.col("x.b").alias("before"), "after", "label").where(F.length("candidate") >= 16)


def train(findings: DataFrame, trees: int = 30, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel:
    """A forest over :data:`FEATURES` from labelled findings. Rows without a label or candidate are left out."""
    known = findings.where("label is not null and candidate is not null").na.fill("", ["before", "after"])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(known))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=1.0).fit(rows.select("features", "label"))


def secret_probability(model: RandomForestClassificationModel) -> Column:
    return F.get(vector_to_array("probability"), 1)


def scan(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text: str = "text", cut: float = 0.5) -> DataFrame:
    """``id_col``, ``start``, ``length``, ``sha256`` of the candidate, ``score`` and ``secret`` for each candidate.

    The candidate itself isn't returned. Null and empty texts have none; null
    ids and repeated rows pass through; other columns aren't read.
    """
    stages = PipelineModel([VectorAssembler(inputCols=list(FEATURES), outputCol="features"), model])
    judged = stages.transform(with_features(candidates(docs, id_col, text)))
    score = F.round(secret_probability(model), 6)
    return judged.select(id_col, "start", F.length("candidate").cast("long").alias("length"), F.sha2("candidate", 256).alias("sha256"), score.alias("score"), (score >= cut).alias("secret"))
