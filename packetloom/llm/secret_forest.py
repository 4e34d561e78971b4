"""Secret scan with a random forest that removes false positives; native expressions only.

A candidate is a run of 16 or more letters, digits and ``+ / _ = -`` that no such character
precedes, or the value after a ``name=`` inside such a run. It goes on past a dot into another
such run with digits and capitals. Web tokens, blocks of private keys and shorter values assigned to
the name of a secret are candidates too. Cutting a text at its candidates gives what stands before and after each of them.
Features: length, character classes and changes between them, transitions that ordinary
words have, how much of it dictionary words cover, whether it is part of a path, and the
neighbouring words. The words beside all candidates of the corpus give the dictionary and
the transitions. Spark's random forest learns from labelled findings; where none are given, from
the corpus's own by their contexts and from examples of each kind of secret.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.tables import first_by_hash, set_apart
from packetloom.session import written

_RUN = "A-Za-z0-9+/_=-"
_WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
_GAP = r"(?:\s|\\[nr])"
# a block of any number of header lines and lines of base64; without an end mark up to its last whole line
_KEY_BLOCK = (
    rf"-----BEGIN [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----(?:{_GAP}++[A-Za-z-]++: [^\r\n\\]++)*+"
    rf"(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)*+(?:{_GAP}*+[A-Za-z0-9+/=]{{0,15}}+{_GAP}*+-----END [A-Z0-9 ]*?PRIVATE KEY(?: BLOCK)?-----)?+"
)
_START = rf"(?:(?<![{_RUN}])|(?<=[A-Za-z0-9_-]=))(?!-*+[A-Za-z_][A-Za-z0-9_-]*+=[A-Za-z0-9+/_-])"
_PLAIN = rf"{_START}[{_RUN}]{{16,}}+(?:\.(?=[{_RUN}]*+(?<=[{_RUN}]))(?=[^0-9.\s]*+[0-9])(?=[^A-Z.\s]*+[A-Z])[{_RUN}]{{16,}}+)*+"
_LONG = rf"{_KEY_BLOCK}|(?<![.{_RUN}]){_WEB_TOKEN}|(?<=[A-Za-z0-9_-]=){_WEB_TOKEN}|{_PLAIN}"
# the name of a secret and a sign of assignment, and a shorter value or one with other signs behind them
_NAME = (
    r"(?=[aAcCpPsStT])(?i:token|secret|passw|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential)"
    r"\w*+[\"']?+\s*+(?:=>|=|:)\s*+[\"'`]?+"
)
_ASSIGNED = r"(?=[^\s\"'`,;]*+(?<=[0-9])|[^\s\"'`,;0-9]*+[0-9])(?!\w++[\"']?+\s*+[=:])[^\s\"'`,;<>(){}\[\]=:]{6,}+"
# the password of a url
_LOGIN, _LOGIN_VALUE = r"(?<=[a-z0-9]://)[^\s:/@\"']*+:", r"[^\s@/\"']{3,}+(?=@)"
CANDIDATE = f"({_NAME})({_LONG}|{_ASSIGNED})|({_LOGIN})({_LOGIN_VALUE})|({_LONG})"
#: What stands before the value stays, and the value goes between two marks.
_MARKED = "$1$3", "$2$4$5"
MARK = "[SECRET]"
# Words beside a secret, and beside other long values.
SECRET_WORDS = "token|secret|passw|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth|bearer|credential"
# Values that are secrets wherever they stand.
FORMATS = (
    r"^(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|xox[abprs]-[A-Za-z0-9-]{16,}|AIza[\w-]{35}|npm_[A-Za-z0-9]{36}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}"
    r"|(?:com/)?services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{20,}|-----BEGIN [A-Z0-9 ]*PRIVATE KEY[\s\S]*)$"
)
OTHER_WORDS = "commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|revision|license|version|isbn|page"
FEATURES = [
    "size", "digits", "upper", "lower", "signs", "hex", "variety", "changes", "ordinary", "covered", "path", "in_path",
    "near_secret", "near_other", "assigned", "quoted", "secret_after", "other_after", "login",
    "format", "header",
]
HEADER = r"(?:\bbearer|authorization[\"']?\s*[:=]\s*[\"']?(?:basic|token))\s+$"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Words of the dictionary, the most frequent beside candidates: a pattern of fixed size.
DICTIONARY = 400


def pieces(text: Column) -> Column:
    """A text cut at its candidates: what stands around them on even places, they on odd ones.

    One pass puts a mark, a digest of the text, around every value, and the marks cut it.
    """
    mark = F.concat(F.lit("<"), F.md5(text), F.lit(">"))
    return F.split(F.regexp_replace(text, F.lit(CANDIDATE), F.concat(F.lit(_MARKED[0]), mark, F.lit(_MARKED[1]), mark)), mark, -1)


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest (of the text), nth (from 0), start, end (characters), value, before, after.

    One row per candidate of each row; ``before`` and ``after`` are up to 80 characters of the
    text between it and its neighbours. Null and empty texts have none.
    """
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("t"))
    cut = source.select(
        F.monotonically_increasing_id().alias("_row"), "doc_id", F.md5("t").alias("digest"), pieces(F.col("t")).alias("p")
    ).where(F.size("p") > 1)
    values, gaps = F.filter("p", lambda _, i: i % 2 == 1), F.filter("p", lambda _, i: i % 2 == 0)
    each = F.arrays_zip(
        values.alias("values"),
        F.transform(gaps, lambda p: F.length(p)).alias("gap"),
        F.transform(gaps, lambda p: F.right(p, F.lit(80))).alias("before"),
        F.slice(F.transform(gaps, lambda p: F.left(p, F.lit(80))), F.lit(2), F.size(values)).alias("after"),
    )
    each = F.slice(each, F.lit(1), F.size(values))
    rows = cut.select("_row", "doc_id", "digest", F.posexplode(each).alias("nth", "c"))
    so_far = Window.partitionBy("_row").orderBy("nth")
    end = F.sum(F.col("c.gap") + F.length("c.values")).over(so_far)
    return rows.withColumn("end", end).select(
        "doc_id", "digest", "nth", (F.col("end") - F.length("c.values")).alias("start"), "end",
        F.col("c.values").alias("value"), "c.before", "c.after",
    )


def _word_beside(rows: DataFrame) -> DataFrame:
    beside = F.concat_ws(" ", "before", "after")
    return rows.select(F.explode(F.regexp_extract_all(F.lower(beside), F.lit(r"(?<!\p{L})[a-z]{2,12}(?!\p{L})"), 0)).alias("w"))


def surroundings(rows: DataFrame, dictionary: int = DICTIONARY) -> tuple[str, list[float]]:
    """A pattern of the most frequent words of three letters or more beside candidates, and the
    log share of each of the 26 x 26 letter transitions in such words."""
    counts = _word_beside(rows).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    often = counts.where(F.length("w") >= 3).orderBy(F.desc("n"), "w").limit(dictionary).collect()
    spread = counts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda i: F.substring("w", i, F.lit(2)))).alias("b"))
    pairs = dict(spread.groupBy("b").agg(F.sum("n")).collect())  # at most 676
    total = sum(pairs.values()) + 26 * 26
    shares = [math.log((pairs.get(a + b, 0) + 1) / total) for a in LETTERS for b in LETTERS]
    words = sorted((r.w for r in often), key=lambda w: (-len(w), w))
    return "|".join(words) or r"(?!)", shares


def _share(value: Column, pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def with_features(rows: DataFrame, known: tuple[str, list[float]]) -> DataFrame:
    """``rows`` of candidates with the columns ``FEATURES`` (double)."""
    pattern, shares = known
    v, low = F.col("value"), F.lower("value")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]+", "#"), "[a-z]+", "a"), "[A-Z]+", "A"), "[+/_=-]+", ".")
    table = F.array(*[F.lit(x) for x in shares])
    pairs = F.regexp_extract_all(low, F.lit("(?=([a-z]{2}))"), 1)
    share_of = lambda p: F.get(table, (F.ascii(p) - 97) * 26 + F.ascii(F.right(p, F.lit(1))) - 97)
    steps = F.transform(pairs, share_of)  # other transitions count as very rare ones
    others = (F.length("value") - 1 - F.size(pairs)) * F.lit(-12.0)
    close, behind = F.lower(F.right("before", F.lit(40))), F.lower(F.left("after", F.lit(40)))
    values = {
        "size": F.length("value"),
        "digits": _share(v, "[0-9]"),
        "upper": _share(v, "[A-Z]"),
        "lower": _share(v, "[a-z]"),
        "signs": _share(v, "[+/_=-]"),
        "hex": F.regexp_like(v, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "variety": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
        "changes": F.length(classes) / F.length("value"),
        "ordinary": (F.aggregate(steps, others, lambda s, x: s + x)) / F.greatest(F.length("value") - 1, F.lit(1)),
        "covered": _share(low, pattern),
        "path": F.regexp_like(v, F.lit("/[A-Za-z_-]+/|^/|/$")),
        "in_path": F.regexp_like("before", F.lit(r"(?:://|[./\\@])\S*$")),
        "near_secret": F.regexp_like(close, F.lit(SECRET_WORDS)),
        "near_other": F.regexp_like(close, F.lit(OTHER_WORDS)),
        "assigned": F.regexp_like(close, F.lit(r"[=:]\s*[\"'`]?$")),
        "quoted": F.regexp_like(close, F.lit(r"[\"'`]$")) & F.regexp_like("after", F.lit(r"^[\"'`]")),
        "secret_after": F.regexp_like(behind, F.lit(SECRET_WORDS)),
        "other_after": F.regexp_like(behind, F.lit(OTHER_WORDS)),
        "login": F.regexp_like("before", F.lit(r"://[^\s:/@]*:$")),
        "format": F.regexp_like(v, F.lit(FORMATS)),
        "header": F.regexp_like(close, F.lit(HEADER)),
    }
    return rows.withColumns({k: values[k].cast("double") for k in FEATURES})


def reviewed(rows: DataFrame) -> Column:
    """The label of a finding where no reviewer gave one, or null.

    1 for a value with digits that is assigned to a name of a secret, stands in an authorization
    header or is the password of a url, and for a value in the format of a key; 0 for one
    without the name of a secret near it. What only stands near such a name is left open.
    """
    near = F.concat(F.lower(F.right("before", F.lit(40))), F.lit(" "), F.lower(F.left("after", F.lit(40))))
    assigned = F.lit(rf"(?:(?:{SECRET_WORDS})\w*[\"']?\s*(?:=|:|=>)\s*[\"'`]?$)|(?:{HEADER})|://[^\s:/@]*:$")
    named = F.regexp_like(F.lower(rows["before"]), assigned) & F.regexp_like(rows["value"], F.lit("[0-9]"))
    sure = named | F.regexp_like(rows["value"], F.lit(FORMATS))
    return F.when(sure, 1.0).when(~F.regexp_like(near, F.lit(SECRET_WORDS)), 0.0)


def example_texts(seed: int = 8, each: int = 80) -> list[tuple[str, str, float]]:
    """kind, text and label: ``each`` texts of every kind of secret and of harmless values."""
    rng = random.Random(seed)
    lower, upper, digits = LETTERS, LETTERS.upper(), "0123456789"
    base64 = lower + upper + digits + "+/"
    any_of = lambda k, letters: "".join(rng.choices(letters, k=k - 1)) + rng.choice(digits)
    hexes = lambda k: any_of(k, digits + "abcdef")
    plain = lambda k: any_of(k, lower + upper + digits)
    fill = "the and that for with this from value line of see which use set in old new call".split()
    prose = lambda: " ".join(rng.choices(fill, k=rng.randint(1, 8)))
    word = lambda: rng.choice("src main utils config handler index module server render parser".split())
    key_lines = lambda: "\n".join(any_of(64, base64) for _ in range(rng.randint(3, 25)))
    kinds = {
        "env": (1.0, lambda: rng.choice(["API_KEY", "AWS_SECRET_ACCESS_KEY", "DB_PASSWORD", "GITHUB_TOKEN", "app_secret", "auth_token"]) + "=" + rng.choice([hexes(32), hexes(40), any_of(40, base64), plain(24)])),
        "bearer": (1.0, lambda: "Authorization: Bearer " + rng.choice([plain(32), hexes(40), any_of(44, base64)])),
        "format": (1.0, lambda: rng.choice(["AKIA" + any_of(16, upper + digits), "ghp_" + plain(36), "sk_live_" + plain(24), "AIza" + plain(35), "xoxb-" + any_of(12, digits) + "-" + plain(24), "glpat-" + plain(20)])),
        "web": (1.0, lambda: f"eyJ{plain(17)}.eyJ{plain(rng.randint(20, 90))}.{plain(43)}"),
        "pem": (1.0, lambda: (lambda n: f"-----BEGIN {n}PRIVATE KEY-----\n{key_lines()}\n-----END {n}PRIVATE KEY-----")(rng.choice(["", "RSA ", "EC ", "OPENSSH "]))),
        "short": (1.0, lambda: rng.choice(["password", "DB_PASSWORD", "passwd", "api_key", "secret"]) + rng.choice(["=", ": ", " = "]) + any_of(rng.randint(8, 15), lower + upper + digits)),
        "quoted": (1.0, lambda: f'{rng.choice(["token", "api_key", "secret", "password"])} = "{rng.choice([hexes(40), plain(32), hexes(32)])}"'),
        "prose": (1.0, lambda: (lambda v, n: rng.choice([f"my {n} is {v}", f"{v} is the {n}", f"use {n} {v}", f"the {n} was {v}"]))(rng.choice([hexes(32), hexes(44), plain(24), any_of(40, base64), "-".join(hexes(k) for k in (8, 4, 4, 4, 12))]), rng.choice(["token", "api key", "azure secret", "password", "access key"]))),
        "named uuid": (1.0, lambda: (lambda v, n: rng.choice([f"my {n} is {v}", f"{v} is the {n}", f"{n}: {v}"]))("-".join(hexes(k) for k in (8, 4, 4, 4, 12)), rng.choice(["token", "api key", "azure secret", "client secret", "access key"]))),
        "login": (1.0, lambda: rng.choice(["postgres", "mysql", "amqp", "https"]) + f"://{word()}:{any_of(rng.randint(8, 20), lower + upper + digits)}@{word()}.local/{word()}"),
        "hook": (1.0, lambda: "https://hooks.slack.com/services/T" + any_of(9, upper + digits) + "/B" + any_of(9, upper + digits) + "/" + plain(24)),
        "other prose": (0.0, lambda: (lambda v, n: rng.choice([f"the {n} is {v}", f"{v} is the {n}", f"see {n} {v}"]))(rng.choice([hexes(32), hexes(40), hexes(64)]), rng.choice(["checksum", "commit", "revision", "digest", "sha256"]))),
        "named": (0.0, lambda: rng.choice(["commit", "sha256", "checksum", "revision", "build_hash", "md5"]) + rng.choice(["=", ": ", " "]) + rng.choice([hexes(40), hexes(64), hexes(32)])),
        "path": (0.0, lambda: rng.choice(["path=", "", "file: "]) + "/" + "/".join(word() for _ in range(rng.randint(4, 7)))),
        "identifier": (0.0, lambda: rng.choice(["name=", "", "class "]) + "_".join(word() for _ in range(rng.randint(3, 5)))),
        "uuid": (0.0, lambda: rng.choice(["id=", "uuid: ", ""]) + "-".join(hexes(k) for k in (8, 4, 4, 4, 12))),
        "number": (0.0, lambda: rng.choice(["isbn ", "page=", ""]) + any_of(rng.randint(16, 20), digits)),
        "certificate": (0.0, lambda: f"-----BEGIN CERTIFICATE-----\n{any_of(64, base64)}\n-----END CERTIFICATE-----"),
    }
    return [(kind, f"{prose()} {make()} {prose()}", label) for kind, (label, make) in kinds.items() for _ in range(each)]


def examples(spark: SparkSession) -> DataFrame:
    """Labelled findings of :func:`example_texts`: value, before, after, label."""
    rows = F.from_json(F.lit(json.dumps([{"doc_id": y, "text": t} for _, t, y in example_texts()])), F.lit("array<struct<doc_id:double,text:string>>"))
    return candidates(spark.range(1).select(F.inline(rows))).select("value", "before", "after", F.col("doc_id").alias("label"))


def fit(findings: DataFrame, *, always: DataFrame | None = None, per_label: int = 10_000, trees: int = 40, depth: int = 10) -> Model | None:
    """A forest from findings with ``FEATURES`` and ``label`` (0, 1; null: not used).

    Of each label at most ``per_label`` different findings are used, those that come first by
    hash, and all of ``always``.
    None if there are not findings of both labels.
    """
    used = first_by_hash(findings.where("label is not null"), "label", ["value", "before"], per_label)
    used = used.select(*FEATURES, "label")
    if always is not None:
        used = used.unionByName(always.select(*FEATURES, "label"))
    used = written(used, "labelled")
    if used.select("label").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(used)
    # equal weight to both labels
    n = dict(data.groupBy("label").count().collect())
    data = data.withColumn("weight", F.when(F.col("label") == 1, F.lit(1 / n[1.0])).otherwise(F.lit(1 / n[0.0])) * F.lit(float(sum(n.values()) / 2)))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, weightCol="weight", featureSubsetStrategy="sqrt")
    return forest.fit(data.select("features", "label", "weight"))


def judged(rows: DataFrame, model: Model | None) -> DataFrame:
    """``rows`` with ``probability`` of being a secret; without a model, their weak label."""
    if model is None:
        return rows.withColumn("probability", reviewed(rows))
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)
    out = model.transform(data).withColumn("p", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "prediction", "probability").withColumnRenamed("p", "probability")


def secrets(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    findings: DataFrame | None = None,
    least: float = 0.5,
    per_label: int = 10_000,
) -> DataFrame:
    """Findings that the forest keeps: doc_id, digest, nth, start, end, value, before, after, probability.

    ``findings`` are labelled ones (``value``, ``before``, ``after``, ``label``); without them
    the corpus's own candidates are labelled by :func:`reviewed` and :func:`examples` are added. Every candidate of every
    whole text is judged. Repeated rows have their findings each; a null doc_id stays null;
    an empty table has no findings.
    """
    rows = written(candidates(docs, doc_id, text), "candidates")
    known = surroundings(rows)
    always = None
    if findings is None:
        always = with_features(examples(docs.sparkSession), known)
        labelled = rows.withColumn("label", reviewed(rows))
    else:
        labelled = findings.select("value", "before", "after", F.col("label").cast("double").alias("label"))
    model = fit(with_features(labelled, known), always=always, per_label=per_label)
    found = judged(with_features(rows, known), model)
    return found.where(F.col("probability") >= least).drop(*FEATURES)


def redact(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", mark: str = MARK, **how) -> DataFrame:
    """``docs`` with every kept finding replaced by ``mark``; no row is dropped."""
    hits = secrets(docs, doc_id=doc_id, text=text, **how)
    docs, back = set_apart(docs, doc_id, text)
    own = F.col(f"`{doc_id}`")
    keys = {"_k1": own.isNull(), "_k2": F.coalesce(own.cast("string"), F.lit("")), "_k3": F.md5(F.col(f"`{text}`"))}
    hits = hits.groupBy(
        F.col("doc_id").isNull().alias("_k1"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_k2"), F.col("digest").alias("_k3")
    ).agg(F.collect_set("nth").alias("_hits"))
    t = F.col(f"`{text}`")
    hit = lambda i: (i % 2 == 1) & F.array_contains("_hits", F.shiftright(i, 1))
    joined = F.array_join(F.transform(pieces(t), lambda p, i: F.when(hit(i), F.lit(mark)).otherwise(p)), "")
    new = F.when(F.col("_hits").isNull(), t).otherwise(joined)
    out = docs.withColumns(keys).join(hits, ["_k1", "_k2", "_k3"], "left")
    return back(out.withColumn(text, new))
