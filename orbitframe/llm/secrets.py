"""Secret scans: candidates by rule, false positives removed by a random forest; DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orbitframe.session import cut_lineage, read_table

#: Names of secrets, whatever stands before them; their assigned values are looked at from 6 characters on.
NAMES = r"(?i:passw(?:or)?d|passwort|kennwort|passphrase|pwd|contrase[nñ]a|mot_de_passe|secret|token|(?:api|access|secret|private|auth)[_-]?key|auth|credentials?)"
ASSIGN, QUOTE = r"[\"']{0,1}[=:]{1,2}", r"[\"']{0,1}"
#: A run of 16 key characters or more, of any length, or dotted tokens; not what a value is assigned to. A run needs a digit or 16 capitals (STRONG).
_FREE = rf"(?!(?<={NAMES}){ASSIGN})"
CANDIDATE = rf"(?:[A-Za-z0-9_\-]{{10,}}+\.){{2,}}+[A-Za-z0-9_\-]{{10,}}+{_FREE}|(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{{16,}}+{_FREE}(?:={{1,2}}(?![A-Za-z0-9+/_\-\"']))?"
STRONG = r"[0-9]|[A-Z]{16}"
#: A value ends at its quote, else at white space, quotes, < and >, and at , ; & if that ends the word or the next name follows.
_DOUBLE, _SINGLE = r"[^\x20\x09-\x0D\"]{6,}+", r"[^\x20\x09-\x0D']{6,}+"
_BARE = r"(?:[^\x20\x09-\x0D\"'<>,;&]|[,;&](?![\x20\x09-\x0D\"']|$|[A-Za-z0-9_.\-]{1,40}[\"']{0,1}[=:])){6,}+"
_NAME = rf"(?<={NAMES}{ASSIGN}"
#: The password in front of a host.
_LOGIN = r"://[^\x20\x09-\x0D/@:]{1,64}:"
_HOST = rf"(?<={_LOGIN})[^\x20\x09-\x0D/@]{{6,}}+(?=@)"
ASSIGNED = rf"{_NAME}\"){_DOUBLE}|{_NAME}'){_SINGLE}|{_NAME}){_BARE}|{_HOST}|{CANDIDATE}"
VALUE = rf"(?<=^\"){_DOUBLE}|(?<=^'){_SINGLE}|^{_BARE}|{CANDIDATE}"
NAMED = rf"{NAMES}{ASSIGN}$"
#: What texts without any candidate lack; they are not split. Each part begins with what is rare: a run's start with a digit behind, a sign, a dot.
HINT = (
    r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16}|[A-Z]{16}|\.(?<=[A-Za-z0-9_\-]{10}\.)[A-Za-z0-9_\-]{10}"
    rf"|[=:](?<=(?:{NAMES}[\"']{{0,1}}|[\x20\x09-\x0D])[=:])|:(?<={_LOGIN})"
)
#: Words that parts of a harmless candidate consist of.
DICTIONARY = (
    "the", "and", "that", "this", "with", "from", "test", "example", "sample", "demo", "dummy", "user", "name", "file", "path", "page", "index", "image",
    "http", "https", "html", "json", "data", "date", "time", "version", "release", "build", "commit", "branch", "master", "main", "update", "config",
    "default", "value", "number", "string", "order", "invoice", "article", "chapter", "section", "figure", "table", "node", "item", "list", "group", "team", "your", "here", "changeme", "placeholder", "model", "serial", "part", "report", "draft",
)
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api", "key", "auth", "bearer", "credential", "credentials", "access", "private", "login", "aws")
HARMLESS_WORDS = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "uuid", "guid", "id", "etag", "revision", "version", "example", "sample", "isbn", "order", "invoice", "tracking", "card", "phone", "account")
TEST_PATHS = r"(?i)(test|spec|fixture|example|sample|mock|doc|vendor|lock)"
#: Classes of characters whose transitions are counted: vowel, consonant, upper case, digit, other.
CLASSES = "vcudo"
FEATURES = (
    "length", "digits", "uppers", "lowers", "others", "hex_only", "digits_only", "distinct",
    *(f"t_{a}{b}" for a in CLASSES for b in CLASSES), "dictionary", "test_path", "key_before", "harmless_before", "assigned", "quoted", "key_after", "harmless_after",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _classes(text: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[A-Z]", "A")
    plain = F.regexp_replace(F.regexp_replace(plain, "[aeiou]", "v"), "[b-df-hj-np-tw-z]", "c")
    return F.translate(F.regexp_replace(plain, "[^vcA0]", "o"), "A0", "ud")


def dictionary_words(docs: DataFrame, text_col: str = "text", most: int = 256, least: int = 20) -> tuple[str, ...]:
    """DICTIONARY and the words of four letters or more that most documents hold: ``most`` of them at most, each in ``least`` documents at least.

    Document frequencies cover all texts; they are summed before the exchange.
    """
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text_col}`")), F.lit("[a-zà-ÿ]{4,24}+(?![a-zà-ÿ])"), 0))).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.col("n").desc(), "word").limit(most)
    return (*DICTIONARY, *(r.word for r in top.collect() if r.word not in SECRET_WORDS))


def feature_columns(word: Column, path: Column, before: Column, after: Column, words: tuple[str, ...] = DICTIONARY) -> list[Column]:
    """The features of a candidate, in the order of FEATURES; nulls count as empty.

    Length, shares of characters, transitions between neighbouring characters' classes (of all
    transitions), share covered by dictionary words, the path, and the words around.
    """
    word, path, before, after = (F.coalesce(c, F.lit("")) for c in (word, path, before, after))
    size = F.greatest(F.char_length(word), F.lit(1)).cast("double")
    classes, low = _classes(word), F.lower(word)
    pairs = F.greatest(size - 1, F.lit(1.0))
    names = lambda some: r"(?i)(?<![a-z])(" + "|".join(some) + r")(?![a-z])"
    covered = size - F.char_length(F.regexp_replace(low, "|".join(sorted(words, key=len, reverse=True)), "")).cast("double")
    return [
        size, _count(word, "[0-9]") / size, _count(word, "[A-Z]") / size, _count(word, "[a-z]") / size, _count(word, "[^A-Za-z0-9]") / size,
        low.rlike("^[0-9a-f]+$").cast("double"), word.rlike("^[0-9]+$").cast("double"), F.size(F.array_distinct(F.split(word, ""))) / size,
        *(_count(classes, f"{a}(?={b})") / pairs for a in CLASSES for b in CLASSES),
        covered / size, path.rlike(TEST_PATHS).cast("double"), before.rlike(names(SECRET_WORDS)).cast("double"), before.rlike(names(HARMLESS_WORDS)).cast("double"),
        before.rlike(r"[=:]\W*$").cast("double"), before.rlike("[\"']$").cast("double"), after.rlike(names(SECRET_WORDS)).cast("double"), after.rlike(names(HARMLESS_WORDS)).cast("double"),
    ]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(id, position, candidate, path, before, after) of every candidate.

    Candidates are dotted tokens, runs of 16 key characters or more that hold a digit or 16 capitals, and
    values of 6 characters or more that are assigned to what ends in the name of a secret (password=..., db_token: ..., "api_key":"...") or stand as a password
    before a host. Names themselves are none. A quoted value ends at its quote, another one at white space, quotes, < or >, and at a comma, semicolon or & before
    the next name or the end of the word. None is cut, however long. position counts the words of the text from 0; a word that holds several candidates
    gives each. before is the two words in front and what of the word itself comes first, after the two
    behind; of a word's several candidates, each is bounded by its neighbours, so what lies between two is
    after the one and before the other, and the words around belong to the outer ones.

    Null and empty texts have none; null ids and paths stay, repeated rows are scanned each. Columns
    besides the three may have any names. An empty table gives no rows.
    """
    words = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{path_col}`").cast("string").alias("path"), F.col(f"`{text_col}`").alias("t"))
    words = words.where(F.col("t").rlike(HINT))
    words = words.select("id", "path", F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"))
    word = lambda i: F.coalesce(F.get("w", i), F.lit(""))
    found = lambda w, pattern: F.regexp_extract_all(w, F.lit(pattern), F.lit(0))
    # The word before names a secret and ends in a sign of assignment, or is that sign.
    # Cheap looks come before patterns, which are tried on few words then.
    signed = lambda w: w.endswith("=") | w.endswith(":")
    named = lambda i: signed(word(i - 1)) & (word(i - 1).rlike(NAMED) | (word(i - 1).isin("=", ":", ":=") & word(i - 2).rlike(rf"{NAMES}{QUOTE}$")))
    worth = lambda w, i: ((F.octet_length(w) >= 16) & w.rlike(STRONG)) | ((w.contains("=") | w.contains(":")) & w.rlike(rf"{NAMES}{ASSIGN}|{_LOGIN}")) | named(i)

    def hit(w: Column, i: Column) -> Column:
        value = named(i)
        return F.struct(i.alias("position"), value.alias("value"), F.when(value, found(w, VALUE)).otherwise(found(w, ASSIGNED)).alias("found"))

    worthy = F.filter(F.transform("w", lambda w, i: F.when(worth(w, i), hit(w, i))), lambda x: x.isNotNull() & (F.size(x.found) > 0))
    held = words.select("id", "path", "w", F.explode(worthy).alias("x"))
    at = F.col("x.position")
    around = lambda *i: F.concat_ws(" ", *map(word, i))
    parts = F.when(F.col("x.value"), F.split(word(at), VALUE, -1)).otherwise(F.split(word(at), ASSIGNED, -1))
    held = held.select("id", "path", at.alias("at"), F.col("x.value").alias("value"), F.col("x.found").alias("found"), parts.alias("parts"), around(at - 2, at - 1).alias("front"), around(at + 1, at + 2).alias("behind"))
    rows = held.select("*", F.posexplode("found").alias("k", "candidate"))
    head, tail = F.get("parts", F.col("k")), F.get("parts", F.col("k") + 1)
    short = F.col("value") | head.rlike(rf"(?:{NAMES}{ASSIGN}{QUOTE}|{_LOGIN})$")
    before = F.when(F.col("k") == 0, F.concat_ws(" ", "front", head)).otherwise(head)
    after = F.when(F.col("k") == F.size("found") - 1, F.concat_ws(" ", tail, "behind")).otherwise(tail)
    return rows.where(F.col("candidate").rlike(STRONG) | short).select("id", F.col("at").cast("long").alias("position"), "candidate", "path", F.trim(before).alias("before"), after.alias("after"))


def example_findings(spark: SparkSession, n: int = 4_000) -> DataFrame:
    """Labelled findings (candidate, path, before, after, label) made by rule: ``n`` rows, 9 of 20 of them secrets.

    Secrets: access key ids, hexadecimal and base64 strings and short mixed values after names of secrets,
    with and without quotes, dotted tokens, and bare key ids among prose. Others: numbers such as cards and
    orders, commit and check sums, uuids, versions, place holders, identifiers of dictionary words, prose
    after names of secrets. Paths and following words vary for both labels: others lie in test
    and documentation paths and are followed by harmless words more often, secrets are by names of secrets.
    """
    digest = lambda k: F.sha2(F.concat(F.lit(k), F.col("i").cast("string")), 512)
    among = lambda k, n: F.pmod(F.xxhash64("i", F.lit(k)), F.lit(n))
    pick = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (among(k, len(words)) + 1).cast("int"))
    raw = lambda k: F.translate(F.base64(F.unhex(digest(k))), "\r\n", "")
    upper = F.substring(F.translate(F.upper(raw("u")), "+/=", "XYZ"), 1, 16)
    hexa = lambda size: F.substring(digest("h"), F.lit(1), size)
    b64 = F.substring(raw("b"), 1, 40)
    plain = lambda k: F.translate(raw(k), "+/=", "xyz")
    short = F.concat(F.substring(plain("s"), F.lit(1), (among("l", 7) + 5).cast("int")), F.substring(F.translate(digest("d"), "abcdef", "123456"), 1, 2))
    dotted = F.concat(F.lit("eyJ"), F.substring(plain("j"), 1, 17), F.lit("."), F.substring(plain("k"), 1, 60), F.lit("."), F.substring(plain("m"), 1, 43))
    number = F.substring(F.translate(digest("n"), "abcdef", "123456"), 1, 16)
    uuid = F.concat_ws("-", *(F.substring(digest("g"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    named = F.concat_ws("_", pick(DICTIONARY, "a"), pick(DICTIONARY, "b"), pick(DICTIONARY, "c"), F.substring(number, 1, 4))
    shouted = F.upper(F.concat(pick(DICTIONARY, "a"), pick(DICTIONARY, "b"), pick(DICTIONARY, "c"), pick(DICTIONARY, "d"), pick(DICTIONARY, "e")))
    prose = ("the", "of", "and, in", "is that", "for the", "est de la", "und der", "que los")
    said = ("required", "optional", "incorrect", "settings", "changed", "forgotten", "expired", "missing", "please", "another", "length", "policy", "strength", "rotation")
    quiet, loud, calm = pick(prose, "p"), pick(SECRET_WORDS[:6], "s"), pick(HARMLESS_WORDS, "q")
    sizes = F.element_at(F.array(*map(F.lit, (16, 18, 20, 24, 32, 40, 64))), (among("z", 7) + 1).cast("int"))
    spoken = lambda *mark: F.concat(quiet, F.lit(" "), loud, *map(F.lit, mark))
    made = [
        (1, F.concat(F.lit("AKIA"), upper), quiet), (1, F.concat(F.lit("AKIA"), upper), F.concat(quiet, F.lit(" key: "))),
        (1, hexa(sizes), F.concat(loud, F.lit("="))), (1, hexa(sizes), spoken(' = "')), (1, b64, F.concat(loud, F.lit(": "))), (1, b64, spoken("='")),
        (1, short, F.concat(loud, F.lit("="))), (1, short, spoken(':')), (1, dotted, spoken(" ")),
        (0, number, quiet), (0, number, F.concat(calm, F.lit(" "))), (0, hexa(F.lit(40)), F.concat(calm, F.lit(" "))), (0, hexa(sizes), F.concat(calm, F.lit("="))), (0, uuid, F.concat(calm, F.lit("="))), (0, uuid, quiet),
        (0, named, quiet), (0, named, F.concat(loud, F.lit("="))), (0, shouted, quiet), (0, pick(said, "w"), spoken(":")), (0, pick(DICTIONARY, "a"), F.concat(loud, F.lit("="))),
    ]
    rows = spark.range(n).withColumnRenamed("id", "i").withColumn("kind", (F.col("i") % len(made)).cast("int"))
    shown = F.array(*(F.struct(c.alias("candidate"), b.alias("before"), F.lit(float(y)).alias("label")) for y, c, b in made))
    rows = rows.select("i", F.element_at(shown, F.col("kind") + 1).alias("x"))
    places = ("src/app", "config/prod", "src", "deploy", "notebooks", "web")
    apart = ("tests/unit", "docs/api", "fixtures", "examples", "vendor/lib", "mocks")
    odd = F.when(F.col("x.label") == 1, among("path", 8) == 0).otherwise(among("path", 8) < 5)
    path = F.concat(F.when(odd, pick(apart, "x")).otherwise(pick(places, "x")), F.lit("/"), among("f", 90).cast("string"))
    turn = among("after", 10)
    calmed = F.when(F.col("x.label") == 1, turn == 0).otherwise(turn < 4)
    behind = F.when(calmed, F.concat(calm, F.lit(" "), quiet)).when((F.col("x.label") == 1) & (turn > 6), F.concat(F.lit('" '), pick(SECRET_WORDS, "e"))).when(turn == 9, pick(SECRET_WORDS, "e")).otherwise(pick(prose, "e"))
    return rows.select("x.candidate", path.alias("path"), "x.before", behind.alias("after"), "x.label")


def fit(findings: DataFrame, most: int = 50_000, words: tuple[str, ...] = DICTIONARY) -> RandomForestClassificationModel:
    """A forest on labelled findings, ``most`` of the least hashes at most; null labels are left out.

    Labels of one kind only give a forest that always says that kind.
    """
    rows = findings.where("label is not null").orderBy(F.xxhash64("candidate", "before"), "candidate").limit(most)
    x = F.array(*feature_columns(F.col("candidate"), F.col("path"), F.col("before"), F.col("after"), words))
    rows = cut_lineage(rows.select("label", x.alias("x")))
    return RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=24, maxDepth=8, seed=3).fit(rows.select("label", array_to_vector("x").alias("features")))


def scan_secrets(docs: DataFrame, findings: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """(id, position, candidate, before, score, is_secret) of every candidate of every text.

    The dictionary of the forest's coverage feature is that of the texts (dictionary_words). score is the forest's share of votes for a secret; is_secret: it is ``threshold`` or more. Null ids
    and paths, repeated rows and ties stay; null and empty texts and an empty table give no rows; texts
    and candidates of any length are read whole. Other columns, whatever their names, aren't read.
    """
    words = dictionary_words(docs, text_col)
    model = fit(findings, words=words)
    found = candidates(docs, id_col, text_col, path_col)
    x = F.array(*feature_columns(F.col("candidate"), F.col("path"), F.col("before"), F.col("after"), words))
    scored = model.transform(found.withColumn("features", array_to_vector(x)))
    scored = scored.withColumn("score", F.round(vector_to_array("probability")[1], 9))
    return scored.select("id", "position", "candidate", "before", "score", (F.col("score") >= threshold).alias("is_secret"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"), example_findings(spark))
    return found.select(F.col("id").alias("doc_id"), "position", "candidate", "score", "is_secret")
