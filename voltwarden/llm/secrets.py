"""Scans for secrets: patterns propose candidates, a random forest trained from labelled findings removes the false ones.

All of the main path is built-in expressions and Spark's own forest: candidates, their features (length, character
transitions, dictionary coverage, path, neighbouring words) and the trained model's transform run in the JVM.
"""

from __future__ import annotations

import random
import string

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pii import located

# Forms of candidates. Each begins where no run of its characters goes on, so long runs stay linear.
#: Known forms of keys, private key blocks, and any long run of characters that keys are made of. '=' ends a run and may
#: stand before the next, as in KEY=value. A key block goes on to its END line, whatever is in between and however long
#: that is; where the text, or another block, cuts it off before that, over what looks like its body and headers.
CANDIDATE = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:(?:Proc-Type|DEK-Info|Comment|Subject|X-[A-Za-z-]++):[^\r\n\\]*+|[A-Za-z0-9+/=\s]|\\[nrt/])*+)"
    r"|(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}+={0,2}+"
)
KNOWN = r"^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|//hooks\.slack\.com/services/T[A-Za-z0-9_]+/B[A-Za-z0-9_]+/[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{20}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+|-----BEGIN .*)"
FOR = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credential|client[_-]?secret|signing[_-]?key)s?"
AGAINST = r"(?:example|sample|test|dummy|placeholder|sha-?(?:1|256|512)|md5|checksum|digest|commit|revision|hash|uuid|guid|etag|integrity|version|build|fingerprint)"
#: The parts that words of texts and of code are made of; what they cover of a candidate is no key.
DICTIONARY = "the and ing ion ent ation for her ter hat tha ere ate his con res ver all ons nce men ith ted ers pro thi wit are ess not ive was ect rea com eve per int est sta cti ica ist ear ain one our iti rat tion ment able data file user name test path home main code list type read write class index value table field model admin local config public static system server client src lib bin usr var opt www http https html json java python node module package".split()
#: What labelled findings are made of where there are none of one's own: words in no list of the features, names that a
#: value is assigned to (of secrets, and of what is none), signs of the assignment, and addresses that hold a secret.
PLAIN = "customer invoice shipment quarterly harvest northern cathedral window bicycle laptop garden engine paper yellow silver mountain rivers village captain doctor school teacher kitchen summer winter forest animal market orange travel letter number bridge castle church coffee dinner driver farmer finger flower friend ground health island jacket ladder leader lesson luggage marble memory mirror museum needle office parade pencil people pepper picnic planet pocket police potato prince puzzle rabbit record ribbon saddle sailor salmon season shadow sheep signal singer sister spirit spring square stable street string student sugar sunset supper target temple tennis theatre ticket tiger timber tomato tunnel turtle umbrella valley velvet violin wallet weather weekend welcome whistle wonder yogurt zebra zipper".split()
NAMES = ["token", "secret", "password", "api_key", "apikey", "access_key", "auth_token", "client_secret", "API_KEY", "DB_PASSWORD", "Secret", "private_key", "credential", "signing_key", "access-token", "authToken"]
HARMLESS = ["checksum", "sha1", "md5", "digest", "revision", "commit", "uuid", "etag", "build", "version", "fingerprint", "integrity", "request_id", "trace_id", "session", "guid"]
SIGNS = [' = "', '="', ": '", ' := "', "=", ": ", " ", '": "', " = '", "=>'"]
ADDRESSES = ["postgres://app:", "mysql://root:", "redis://:", "amqp://worker:", "mongodb://admin:", "ftp://backup:", "https://deploy:", "https://"]
#: Code points looked at before and after a candidate; texts that contexts are cut from.
BEFORE, AFTER, TEXTS = 48, 24, 400
FEATURES = ["length", "changes", "digits", "uppers", "vowels", "hexes", "variety", "covered", "longest_word", "slashes", "dots", "path", "assigned", "quoted", "keyword", "against", "known", "userinfo", "uuid"]


def _share(found: Column, removed: str, length: Column) -> Column:
    return (length - F.length(F.regexp_replace(found, removed, ""))) / length


def features(found: Column, before: Column, after: Column) -> dict[str, Column]:
    """The numbers that the forest sees of a candidate and what stands around it."""
    n = F.greatest(F.length(found), F.lit(1)).cast("double")
    low, ahead = F.lower(found), F.lower(before)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[0-9]+", "0"), "[a-z]+", "1"), "[A-Z]+", "2")
    words = "(?:" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": n,
        "changes": F.length(shape) / n,
        "digits": _share(found, "[0-9]", n),
        "uppers": _share(found, "[A-Z]", n),
        "vowels": _share(low, "[aeiou]", n),
        "hexes": flag(low.rlike("^[0-9a-f]+$")),
        "variety": F.size(F.array_distinct(F.split(found, ""))) / F.least(n, F.lit(64.0)),
        "covered": _share(low, words, n),
        "longest_word": F.coalesce(F.array_max(F.transform(F.split(low, "[^a-z]+"), lambda w: F.length(w))), F.lit(0)).cast("double"),
        "slashes": _share(found, "/", n),
        "dots": _share(found, r"\.", n),
        "path": flag(found.rlike(r"^(?:\.{0,2}/|[A-Za-z0-9_-]+/[A-Za-z0-9_.-]+/)|\.(?:py|js|java|html?|txt|json|md|csv|png|jpe?g|gif|com|org|net)$") | before.rlike(r"(?:https?:/|www\.|[/~]|[A-Za-z]:\\)$")),
        "assigned": flag(before.rlike(r"""(?:[:=]|=>|:=)\s*["'`]?$""")),
        "quoted": flag(before.rlike("""["'`]$""") & after.rlike("""^["'`]""")),
        "keyword": flag(ahead.rlike(rf"{FOR}\W{{0,12}}$")),
        "against": flag(ahead.rlike(rf"{AGAINST}\W{{0,12}}$") | low.rlike("example|placeholder|changeme|xxxx")),
        "known": flag(found.rlike(KNOWN)),
        "userinfo": flag(after.startswith("@") & (before.rlike(r"://[^\s/@]{0,24}:?$") | found.startswith("//"))),
        "uuid": flag(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
    }


def labelled_findings(n: int = 4000, seed: int = 3, prose: list[str] | None = None) -> list[tuple[str, str, str, int]]:
    """Labelled findings to train from where there are none of one's own: (found, before, after, label), half of them secrets.

    Secrets are random keys of the usual alphabets or of known forms: assigned to names of secrets, to made names that say
    nothing, in addresses before an @, or bare. The others are words, names, paths, addresses, ids, numbers and
    placeholders, random values assigned to names of checksums and ids, and bare hexadecimal ones. So a name alone decides
    nothing, and none is needed. What stands around them is cut from `prose`.
    """
    rng = random.Random(seed)
    pick = lambda s, k: "".join(rng.choice(s) for _ in range(k))
    hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    made = ["".join(rng.choice(string.ascii_lowercase) if i % 2 == 0 else rng.choice("aeiou") for i in range(rng.randint(2, 4))) for _ in range(300)]
    # half of the made values are of words, half of syllables, as names in other languages are
    word = lambda k: "".join(rng.choice(PLAIN if rng.random() < 0.5 else made) for _ in range(k))
    some = prose or [" ".join(rng.choice(PLAIN) for _ in range(rng.randint(4, 12))) for _ in range(200)]

    def around() -> tuple[str, str]:
        text = rng.choice(some)
        at = rng.randint(0, len(text))
        return text[:at][-BEFORE:], text[at:][:AFTER]

    def named() -> str:
        """A name made of words or syllables, in one of the usual cases."""
        parts = [word(1) for _ in range(rng.randint(1, 3))]
        return rng.choice([lambda: "_".join(parts), lambda: "_".join(parts).upper(), lambda: parts[0] + "".join(x.capitalize() for x in parts[1:]), lambda: "-".join(parts), lambda: ".".join(parts)])()

    def assigned(name: str, found: str, rest: str) -> tuple[str, str]:
        """What stands before and after a value that is assigned to a name."""
        sign = rng.choice(SIGNS)
        name = name.upper() if rng.random() < 0.2 else name
        before = f"{rng.choice(['', 'my_', 'x-', 'export '])}{name}{sign}"
        if rng.random() < 0.25:
            before = before.rstrip("\"'")
        quote = before[-1] if before[-1] in "\"'" else ""
        return before, quote + rng.choice([" ", "\n", ",", ";", "### ", ""]) + rest

    out = []
    keys = [
        lambda: pick(hexes, rng.choice([32, 40, 40, 48, 64])),
        lambda: pick(alnum, rng.randint(16, 64)),
        lambda: pick(alnum + "+/", rng.randint(24, 64)) + rng.choice(["", "=", "=="]),
        lambda: pick(alnum + "-_", rng.randint(20, 300)),
        lambda: pick(string.ascii_uppercase + string.digits, rng.randint(20, 40)),
        lambda: pick(string.ascii_lowercase + string.digits, rng.randint(20, 48)),
    ]
    known = [lambda: rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + (string.digits if rng.random() < 0.7 else ""), 16), lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + pick(alnum, 36), lambda: rng.choice(["sk_live_", "sk_test_", "rk_live_"]) + pick(alnum, rng.randint(20, 40)), lambda: f"//hooks.slack.com/services/T{pick(alnum, 8)}/B{pick(alnum, 8)}/{pick(alnum, 24)}"]
    for i in range(n // 2):
        lead, rest = around()
        kind = i % 10
        if kind < 2:
            found = rng.choice(known)()
            before, after = (("https:" if found.startswith("//") else ""), " " + rest) if rng.random() < 0.5 or found.startswith("//") else assigned(rng.choice([rng.choice(NAMES), named()]), found, rest)
        elif kind == 9:  # in an address
            found, before = rng.choice([keys[0], keys[1], keys[1]])(), rng.choice(ADDRESSES)
            if before == "https://":
                found, before = "//" + found, "https:"
            after = "@" + word(2) + rest
        elif kind == 8:  # bare: of mixed case and digits
            found, before, after = rng.choice(keys[1:3])(), "", rng.choice([" ", "\n", ", "]) + rest
        else:
            found = rng.choice(keys)()
            found = found.upper() if found.islower() and rng.random() < 0.1 else found
            before, after = assigned(rng.choice(NAMES) if kind < 6 else named(), found, rest)
        out.append((found, f"{lead} {before}"[-BEFORE:], after[:AFTER], 1))
    for i in range(n - n // 2):
        kind, (lead, rest) = i % 10, around()
        lead += " "
        found = [
            lambda: word(rng.randint(3, 7)),
            lambda: word(rng.randint(3, 6)).capitalize() + rng.choice(["", "."]),
            lambda: "/".join(word(rng.randint(1, 2)) for _ in range(rng.randint(3, 6))) + rng.choice(["", ".py", ".html"]),
            lambda: rng.choice("-_.").join(word(1) for _ in range(rng.randint(3, 8))),
            lambda: pick(hexes, rng.choice([32, 40, 64])) if rng.random() < 0.6 else pick(alnum + "+/", rng.choice([27, 43, 86])) + "=",
            lambda: "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)),
            lambda: rng.choice(["your_api_key_goes_here", "x" * rng.randint(16, 40), "changeme-changeme-changeme", "EXAMPLE" + pick(alnum, 13), "placeholder_token_value", "<" + word(3) + ">", "insert-token-here", "0" * 32]),
            lambda: pick(string.digits, rng.randint(16, 24)),
            lambda: word(1).capitalize() + "".join(word(1).capitalize() for _ in range(rng.randint(2, 4))),
            lambda: pick(hexes, rng.choice([16, 32, 40, 64])),
        ][kind]()
        after = rng.choice([" ", "\n", ". ", '"']) + rest
        if kind in (0, 3) and rng.random() < 0.25:
            found = found.upper()
        if kind in (4, 5):
            if rng.random() < 0.5:
                lead += rng.choice(["sha1 ", "commit ", "md5: ", "checksum = ", "uuid=", "uuid: \"", 'etag: "', "revision ", "digest ", "sha256:", "integrity sha512-", "fingerprint "])
            else:
                before, after = assigned(rng.choice(HARMLESS), found, rest)
                lead += before
        elif kind == 9:  # bare, or after a word
            lead += rng.choice(["", "", word(1) + " ", "commit ", "see ", "at "])
        elif kind == 6 or kind < 9 and rng.random() < 0.2:  # no key, whatever it is assigned to
            before, after = assigned(rng.choice(NAMES) if rng.random() < 0.4 else named(), found, rest)
            lead += before
        elif kind in (2, 8) and rng.random() < 0.5:
            lead += rng.choice(["https://", "/", "import ", "class ", 'href="'])
        elif rng.random() < 0.15:
            lead += rng.choice(NAMES) + rng.choice([" ", " of ", " for the ", "s and "])
        out.append((found, lead[-BEFORE:], after[:AFTER], 0))
    return out


def stretches(docs: DataFrame, text: str = "text", texts: int = TEXTS) -> list[str]:
    """Stretches of at most `texts` of the corpus's own texts, chosen by a hash, to set labelled findings in."""
    given = docs.select(F.col(text).cast("string").alias("body"))
    total = given.count()
    given = given.where(F.length("body") > 0).select("body", F.xxhash64("body").alias("order"))
    share = F.pmod(F.col("order"), F.lit(1 << 30)) / float(1 << 30)
    some = given.where(share <= 4.0 * texts / max(1, total)).dropDuplicates(["order"]).orderBy("order").limit(texts)
    stretch = F.substr("body", F.pmod(F.col("order"), F.length("body")).cast("int") + 1, F.lit(4 * BEFORE))
    return [r.s for r in some.select(stretch.alias("s")).collect()]


def _assembled(df: DataFrame) -> DataFrame:
    (vector,) = ["features"]
    return VectorAssembler(inputCols=FEATURES, outputCol=vector, handleInvalid="keep").transform(df)


def fit(spark: SparkSession, findings: DataFrame | None = None, docs: DataFrame | None = None, text: str = "text", trees: int = 24, depth: int = 7) -> RandomForestClassificationModel:
    """A forest from labelled findings: found, before, after (strings; null: empty) and label (1: a secret).

    Without findings it learns from made ones, set in stretches of `docs` where these are given. No text of docs is
    labelled by a rule, so what it takes for a secret does not rest on the names before it.
    """
    if findings is None:
        made = labelled_findings(prose=(stretches(docs, text) or None) if docs is not None else None)
        findings = spark.createDataFrame(made, "found string, before string, after string, label int")
    given = findings.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("found", "before", "after")], F.col("label").cast("double").alias("label"))
    rows = given.select("label", *[c.cast("double").alias(k) for k, c in features(F.col("found"), F.col("before"), F.col("after")).items()])
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="0.5", seed=5)
    return forest.fit(_assembled(rows.coalesce(1)).select("label", "features"))


def _candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))


def scan(df: DataFrame, model: RandomForestClassificationModel, keys: list[str], text: str = "text", least: float = 0.5) -> DataFrame:
    """keys, start, end, found, score: a row for each candidate that the forest holds for a secret, in code points, end exclusive.

    Null and empty texts have none. Rows of df that are alike have alike rows. `keys` are columns of df that the result
    carries; their names must not be start, end, found or score.
    """
    body, found, span = "__body", "__found", "__span"
    given = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.coalesce(F.col(text).cast("string"), F.lit("")).alias(body))
    spans = located(given.withColumn(found, _candidates(F.col(body))), body, CANDIDATE, found, span, BEFORE, AFTER)
    own = [f"__k{i}" for i in range(len(keys))]
    # not explode(): the filter that Spark infers from it would be pushed down with the whole expression of the spans
    each = spans.select(*own, F.explode_outer(span).alias(span)).where(F.col(span).isNotNull()).select(*own, f"{span}.*")
    rows = each.select(*own, "start", "end", "found", *[c.cast("double").alias(k) for k, c in features(F.col("found"), F.col("before"), F.col("after")).items()])
    scored = model.transform(_assembled(rows)).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return scored.where(F.col("score") >= least).select(*[F.col(o).alias(k) for o, k in zip(own, keys)], "start", "end", "found", "score")


def forest_score(model: RandomForestClassificationModel, seen: Column) -> Column:
    """The forest's probability of a secret as one expression over a struct of FEATURES: its trees as nested conditions.

    It is what the model's own transform gives, for places where rows must stay together.
    """

    def probability(node) -> Column:
        if node.subtreeDepth() == 0:
            none, some = node.impurityStats().stats()
            return F.lit(some / (none + some))
        split = node.split()
        return F.when(seen[FEATURES[split.featureIndex()]] <= split.threshold(), probability(node.leftChild())).otherwise(probability(node.rightChild()))

    roots = [tree._java_obj.rootNode() for tree in model.trees]
    total = probability(roots[0])
    for root in roots[1:]:
        total = total + probability(root)
    return F.round(total / len(roots), 6)


def redact(df: DataFrame, model: RandomForestClassificationModel, text: str = "text", mark: str = "[SECRET]", least: float = 0.5) -> DataFrame:
    """df with each secret in its text replaced by `mark`, where it stands; all rows and columns stay, null texts are null.

    The same string elsewhere, where the forest holds it for a checksum, stays. Empty tables and texts stay as they are. A row's candidates are scored within the row, so no text leaves its task: no shuffle, whatever rows have in common.
    """
    found, spans, body, shown = common.fresh(df, "found", "spans", "body", "shown")
    given = df.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    given = located(given.withColumn(found, _candidates(F.col(body))), body, CANDIDATE, found, spans, BEFORE, AFTER)

    def seen(x: Column) -> Column:
        own = features(x["found"], x["before"], x["after"])
        return F.struct(x["found"].alias("found"), *[own[k].cast("double").alias(k) for k in FEATURES])

    # each match is put back or replaced in its own place, between the gaps
    secret = F.transform(F.transform(spans, seen), lambda x: F.when(forest_score(model, x) >= least, F.lit(mark)).otherwise(x["found"]))
    given = given.withColumn(shown, F.when(F.size(spans) > 0, secret))
    parts = F.flatten(F.transform(F.arrays_zip(F.split(F.col(body), CANDIDATE, -1).alias("gap"), F.col(shown).alias("shown")), lambda x: F.array(x["gap"], F.coalesce(x["shown"], F.lit("")))))
    return given.withColumn(text, F.when(F.size(spans) > 0, F.array_join(parts, "")).otherwise(F.col(text))).drop(found, spans, body, shown)


def findings(df: DataFrame, model: RandomForestClassificationModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, end, secret_sha256, score: the findings without their text."""
    found = scan(df, model, [doc_id], text)
    return found.select(F.col(doc_id).alias("doc_id"), "start", "end", F.sha2(F.col("found").cast("binary"), 256).alias("secret_sha256"), "score")
