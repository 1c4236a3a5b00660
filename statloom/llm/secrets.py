"""Secret scans: candidate strings, and a random forest that removes the false ones.

Finding, features and scores are DataFrame expressions: a regular expression finds candidates with the text around them;
a forest, grown on the driver from a bounded table of labelled findings, is compiled to CASE expressions over their
features. No Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.llm.common import Scratch

#: Key names whose value is a candidate even if it is short. Fixed values.
KEY_NAMES = "password|passwd|pwd|passphrase|secret|token|api_key|apikey|api-key|access_key|auth_key|private_key|credential|client_secret"
#: A key block, the value of a named key, or a long run with a digit.
CANDIDATE = (
    # a key block holds anything but the marks of a key block: headers of an encrypted one have dashes
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]++|-(?!----(?:BEGIN|END) [A-Z ]{0,20}PRIVATE KEY-----))++-----END [A-Z ]{0,20}PRIVATE KEY-----"
    # what stands before is first looked at for its sign alone, since nearly every place fails there
    rf"|(?<=[:=][ ]?[\x22']?)(?<=(?i:{KEY_NAMES})[\x22']?[ ]?[:=][ ]?[\x22']?)[^\s\x22',;]{{8,}}+"
    r"|(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_=.-]{16,}+"
)
#: A text without any of these holds no candidate; cheaper than the full pattern.
HINT = "[0-9=:]|PRIVATE KEY"
AROUND = 48
#: Entries that a fold takes at a time.
RUN = 256
#: Words that make up names and placeholders but not secrets. Fixed values.
WORDS = (
    "example|sample|test|dummy|fake|placeholder|changeme|change|your|insert|here|xxxx|abcd|1234|none|null|undefined|default|password|passwd|secret|token|key|"
    "access|private|public|user|name|admin|root|value|string|config|version|build|release|index|image|file|path|static|assets|content|data|http|https|www|com|html|"
    "api|auth|login|server|client|local|host|home|page|line|code|hash|commit|date|time|the|and|for|with|from"
)
NEAR_KEYS = r"(?i)(password|passwd|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|private)"
NEAR_FALSE = r"(?i)(example|sample|test|dummy|fake|commit|revision|sha|md5|checksum|digest|hash|uuid|guid|version|build|integrity|etag|isbn|order|invoice|serial)"
FALSE_PATH = r"(?i)(test|spec|mock|fixture|example|sample|docs?/|vendor|lock|\.min\.)"
FORMATS = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^sk-[A-Za-z0-9_-]{20}|^xox[abprs]-|^AIza[A-Za-z0-9_-]{35}|^eyJ[A-Za-z0-9_-]+\.eyJ|^-----BEGIN"
SEED = 6
#: Rows with a secret that are broadcast at most, as a key and a few numbers each.
BROADCAST_ROWS = 200_000


def running(steps: str) -> Column:
    """Running sums of an array of ints. A fold appends by copying, so it goes over blocks of RUN entries and then over the blocks' sums: n to the power 1.5 instead of 2, and linear up to RUN squared."""

    def fold(values: Column, start: Column) -> Column:
        sums = F.aggregate(values, F.array(start).cast("array<int>"), lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x)))
        return F.slice(sums, F.lit(2), F.size(values))

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)), F.lit(RUN)), lambda at: F.slice(F.col(steps), at + 1, F.lit(RUN)))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: a + x))
    before = F.concat(F.array(F.lit(0)), fold(totals, F.lit(0)))
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("own"), F.slice(before, F.lit(1), F.size(blocks)).alias("start")), lambda b: fold(b["own"], b["start"])))


def candidates(docs: DataFrame, text: str, keep: list[str], path: Column | None = None) -> DataFrame:
    """The kept columns and, for every candidate in the text: start (characters before it), value, before, after and path."""
    t = F.col(text)
    found = docs.select(*keep, t.alias("_text"), (path if path is not None else F.lit("")).cast("string").alias("path")).where(t.rlike(HINT)).where(F.col("_text").rlike(CANDIDATE))
    both = found.withColumn("_hits", F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0))).withColumn("_gaps", F.split("_text", CANDIDATE, -1))
    # gap i comes before hit i; a running sum of lengths gives the starts
    both = both.withColumn("_steps", F.transform("_hits", lambda h, i: F.length(F.get("_gaps", i)) + F.when(i == 0, 0).otherwise(F.length(F.get("_hits", i - 1)))))
    starts = running("_steps")
    rows = F.transform(
        F.arrays_zip(starts.alias("start"), F.col("_hits").alias("value")),
        lambda x, i: F.struct(
            x["start"].alias("start"), x["value"].alias("value"), F.substring(F.get("_gaps", i), -AROUND, AROUND).alias("before"), F.substring(F.get("_gaps", i + 1), 1, AROUND).alias("after"),
        ),
    )
    return both.select(*keep, "path", F.inline(rows))


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SHAPE = (_LOWER + _UPPER + "0123456789", "".join("v" if c in "aeiouy" else "c" for c in _LOWER) + "U" * 26 + "0" * 10)


def features() -> dict[str, Column]:
    """Columns over value, before, after and path, all double and never null."""
    v = F.col("value")
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    shape = F.translate(v, *_SHAPE)
    chars = F.split(v, "")
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    beside = F.concat_ws(" ", "before", "after")

    def share(pattern: str) -> Column:
        return F.regexp_count(shape, F.lit(pattern)) / n

    flags = {
        "hex": v.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "upper_digits": v.rlike("^[A-Z0-9]+$"), "dashed_groups": v.rlike("^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"), "numeric": v.rlike("^[0-9._+/=-]+$"), "slashes": v.rlike("/.*/"),
        "dots": v.rlike(r"\..*\."), "format": v.rlike(FORMATS), "assigned": F.col("before").rlike(r"[:=][ ]?[\x22']?$"), "quoted": F.col("before").rlike(r"[\x22']$"), "in_address": F.col("before").rlike(r"([/@#?&%.]|://[^ ]*)$"),
        "near_key": F.col("before").rlike(NEAR_KEYS), "key_beside": F.regexp_extract("before", r"(\S+)\s*\S?\s*$", 1).rlike(NEAR_KEYS), "near_false": beside.rlike(NEAR_FALSE), "false_path": F.col("path").rlike(FALSE_PATH),
    }
    numbers = {
        "length": n, "distinct": F.size(F.array_distinct(chars)) / n, "entropy": F.aggregate(counts, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)),
        "runs": F.length(F.regexp_replace(shape, r"(.)\1+", "$1")) / n, "vowel_consonant": share("vc|cv"), "letter_digit": share("[vcU]0|0[vcU]"), "case_change": share("U[vc]|[vc]U"), "digits": share("0"), "uppers": share("U"), "consonants": share("ccc"),
        "words": F.lit(1.0) - F.length(F.regexp_replace(F.lower(v), f"({WORDS})", "")) / n, "longest_repeat": F.regexp_count(v, F.lit(r"(.)\1\1")) / n, "ladder": F.regexp_count(F.lower(v), F.lit("0123|1234|2345|3456|4567|5678|6789|abcd|bcde|cdef")) / n,
    }
    return {k: F.coalesce(x.cast("double"), F.lit(0.0)) for k, x in (numbers | flags).items()}


@dataclass
class Forest:
    names: list[str]
    trees: list  # nested (feature, bound, left, right) or a share of secrets

    def column(self) -> Column:
        def sql(t) -> str:
            if isinstance(t, float):
                return f"{t:.6f}D"
            k, bound, low, high = t
            return f"CASE WHEN f_{self.names[k]} <= {bound!r}D THEN {sql(low)} ELSE {sql(high)} END"

        return F.expr("(" + " + ".join(sql(t) for t in self.trees) + f") / {len(self.trees)}D")

    def score(self, x: np.ndarray) -> np.ndarray:
        def one(t, rows: np.ndarray, out: np.ndarray) -> None:
            if isinstance(t, float):
                out[rows] += t
            else:
                low = x[rows, t[0]] <= t[1]
                one(t[2], rows[low], out), one(t[3], rows[~low], out)

        out = np.zeros(len(x))
        for t in self.trees:
            one(t, np.arange(len(x)), out)
        return out / len(self.trees)


def grow(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 15, depth: int = 6, least: int = 3, seed: int = SEED) -> Forest:
    """A random forest by Gini impurity: bootstrap rows for each tree, a square root of the features for each split."""
    rng = np.random.default_rng(seed)
    tries = max(2, round(len(names) ** 0.5))

    def node(rows: np.ndarray, d: int):
        p = float(y[rows].mean())
        if d == depth or len(rows) < 2 * least or p in (0.0, 1.0):
            return p
        best, split = p * (1 - p) * len(rows) - 1e-9, None
        for k in rng.choice(len(names), tries, replace=False):
            v = x[rows, k]
            order = np.argsort(v, kind="stable")
            ones, many = np.cumsum(y[rows][order]), np.arange(1, len(rows) + 1)
            at = np.flatnonzero(v[order][1:] > v[order][:-1])
            at = at[(at + 1 >= least) & (len(rows) - at - 1 >= least)]
            if len(at):
                a, n = ones[at], many[at]
                b, m = ones[-1] - a, len(rows) - n
                cost = a * (n - a) / n + b * (m - b) / m
                i = int(np.argmin(cost))
                if cost[i] < best:
                    best, split = cost[i], (int(k), float((v[order][at[i]] + v[order][at[i] + 1]) / 2))
        if split is None:
            return p
        low = x[rows, split[0]] <= split[1]
        return (*split, node(rows[low], d + 1), node(rows[~low], d + 1))

    return Forest(names, [node(rng.integers(0, len(y), len(y)), 0) for _ in range(trees)])


def labelled(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(text, path, label): findings of known kind in made-up surroundings, by expressions over a range, so the same on every run."""
    r = spark.range(rows, numPartitions=1)

    def digest(salt: str) -> Column:
        return F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)

    def pick(salt: str, *options: str) -> Column:
        return F.element_at(F.array(*map(F.lit, options)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(options))) + 1).cast("int"))

    def cut(value: Column, salt: str, low: int, high: int) -> Column:
        return F.substr(value, F.lit(1), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(high - low + 1)) + low).cast("int"))

    h, b = digest("a"), F.regexp_replace(F.base64(F.unhex(F.concat(digest("b"), digest("c")))), "[+/=]", "")
    upper = F.translate(F.upper(F.base64(F.unhex(digest("d")))), "+/=0189", "XYZ2345")
    key = pick("k", "password", "passwd", "token", "secret", "api_key", "access_key", "client_secret", "auth_key")
    sign = pick("s", "=", ": ", " = ", ":")
    quote = pick("q", '"', "", "'")
    prose = [pick(f"w{i}", "the", "anon", "re", "of", "lich", "tion", "and", "mente", "zu", "que", "shed", "inly", "erble", "de", "un", "los", "été", "für") for i in range(10)]
    words = F.concat_ws(" ", *prose[:4])
    more = F.concat_ws(" ", *prose[4:])
    word_run = F.concat(*(pick(f"r{i}", "tion", "er", "lich", "keit", "ment", "ing", "config", "user", "page", "value", "data") for i in range(4)))
    number = F.concat(F.conv(F.substring(h, 1, 12), 16, 10), F.conv(F.substring(h, 13, 8), 16, 10))
    uuid = F.concat_ws("-", *(F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    cases = [
        (1, F.concat(key, sign, quote, cut(h, "n", 16, 64), quote)),
        (1, F.concat(key, sign, quote, cut(b, "n", 12, 60), quote)),
        (1, F.concat(pick("a", "AKIA", "ASIA"), F.substring(upper, 1, 16))),
        (1, F.concat(pick("g", "key ", "use ", ""), pick("p", "ghp_", "sk-", "xoxb-", "AIza"), F.substring(b, 1, 40))),
        (1, F.concat(F.lit("Authorization: Bearer "), cut(b, "n", 30, 80))),
        (1, F.concat(key, sign, quote, cut(b, "n", 10, 14), pick("t", "!", "#9", "$x", "_Q"), quote)),
        (1, F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b, F.lit("\n-----END RSA PRIVATE KEY-----"))),
        (0, F.concat(pick("c", "commit ", "sha256 ", "md5: ", "checksum ", "etag ", "digest "), cut(h, "n", 32, 64))),
        (0, F.concat(pick("u", "id ", "uuid ", "request ", ""), uuid)),
        (0, F.concat(F.lit("https://www."), word_run, F.lit(".com/"), pick("x", "static/", "page/", "images/"), cut(h, "n", 12, 20), F.lit(".html"))),
        (0, F.concat(key, sign, quote, pick("e", "your_password_here", "changeme1234", "example-token-123", "xxxxxxxxxxxxxxxx", "test-secret-value1", "<insert-key-here>", "${ENV_TOKEN_1}", "placeholder_key_0"), quote)),
        (0, F.concat(word_run, pick("v", "-1.2.3", "_v2", "-2024-01-02", "2", ".min.js?v=3", "-10-page-2"))),
        (0, F.concat(pick("o", "order ", "invoice ", "tel ", "isbn ", ""), number)),
        (0, F.concat(word_run, F.lit("/"), word_run, F.lit("/"), pick("f", "v1/file2.py", "2023/index3.html", "img_0001.png"))),
        (0, F.concat(word_run, word_run, F.lit("1"))),
        (0, F.concat(key, sign, quote, word_run, quote)),
    ]
    made = label = None
    for i, (y, text) in enumerate(cases):
        at = F.pmod("id", F.lit(len(cases))) == i
        made = F.when(at, text) if made is None else made.when(at, text)
        label = F.when(at, y) if label is None else label.when(at, y)
    # secrets are rarer in tests and documents, but are there too, so a path alone decides nothing
    ordinary, doubtful = pick("y", "src0", "src1", "app/settings.py", "src2", "deploy/env", "src3"), pick("z", "tests/test_api.py", "docs/readme", "vendor/pkg.lock")
    path = F.when(F.pmod(F.xxhash64(F.lit("path"), "id"), F.lit(8)) < F.when(label == 0, 3).otherwise(1), doubtful).otherwise(ordinary)
    return r.select("id", F.concat_ws(" ", words, made, more).alias("text"), path.alias("path"), label.cast("int").alias("label"))


def train(findings: DataFrame, most: int = 20_000) -> Forest:
    """``findings``: (id, text, path, label 0 or 1). Learns from the longest candidate of each, ``most`` at most, chosen by hash. A finding without a label or a candidate teaches nothing; there must be one that does."""
    f = features()
    findings = Scratch(findings.sparkSession, "findings").save(findings)
    own = candidates(findings, "text", ["id", "label"], F.col("path"))
    rows = own.select("id", "label", *(c.alias(k) for k, c in f.items())).where("label is not null").orderBy(F.xxhash64("id"), F.col("length").desc()).limit(most).collect()
    first = list({r["id"]: r for r in reversed(rows)}.values())
    first.sort(key=lambda r: r["id"])
    return grow(np.array([[r[k] for k in f] for r in first]), np.array([r["label"] for r in first], float), list(f))


def scan(docs: DataFrame, forest: Forest, keep: list[str], text: str = "text", path: Column | None = None, at_least: float = 0.5) -> DataFrame:
    """Every candidate in whole texts: the kept columns, start, value, score and secret (its score reaches ``at_least``).

    Null or empty text: no candidate. Null path: empty. Repeated rows: each has its findings. Empty table: no row. Other columns are not read.
    """
    own = candidates(docs, text, keep, F.coalesce(path.cast("string"), F.lit("")) if path is not None else None)
    f = features()
    # written first: conditions on the score would otherwise repeat every feature's expression at each node of the forest
    rows = Scratch(docs.sparkSession, "candidates").save(own.select("*", *(c.alias(f"f_{k}") for k, c in f.items())))
    scored = rows.withColumn("score", F.round(forest.column(), 6))
    return scored.select(*keep, "start", "value", "before", "score", (F.col("score") >= at_least).alias("secret"))


def redact(docs: DataFrame, forest: Forest, key: str, text: str = "text", path: Column | None = None, mark: str = "[SECRET]", at_least: float = 0.5) -> DataFrame:
    """``docs`` with every secret replaced by the mark. ``key`` must name each row. Only rows that hold a secret are joined with their findings.

    Null and empty texts, texts without a secret and all other columns stay as they are, whatever the columns' names. Repeated rows: each is redacted. Empty table: no row.
    """
    found = Scratch(docs.sparkSession, "secrets").save(scan(docs, forest, [key], text, path, at_least).where("secret").groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(F.struct("start", F.length("value").alias("size")))).alias("_found")))
    t, hits = docs[text], found["_found"]
    ends = F.concat(F.array(F.lit(0)), F.transform(hits, lambda x: x["start"] + x["size"]))
    parts = F.transform(F.concat(F.transform(hits, lambda x: x["start"]), F.array(F.length(t))), lambda start, i: F.substr(t, F.get(ends, i) + 1, start - F.get(ends, i)))
    joined = docs.join(F.broadcast(found) if found.count() <= BROADCAST_ROWS else found, docs[key] == found["_key"], "left")
    return joined.select(*(F.when(hits.isNull(), t).otherwise(F.array_join(parts, mark)).alias(c) if c == text else docs[c] for c in docs.columns))
