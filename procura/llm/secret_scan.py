"""Secrets in text: patterns propose candidates, a random forest drops the harmless ones.

Candidates are values assigned to a telling name, long tokens with a digit,
signed web tokens in their three parts, passwords in the user part of a URL, and
private key headers. Features of a candidate and its neighbours are column
expressions; the forest becomes one nested CASE expression for each tree. So
scanning is a projection and a filter: no shuffle and no Python on the
executors.

What a word looks like comes from the vocabulary file of a public tokenizer, a
parameter that the driver reads: its ``DICTIONARY_WORDS`` most frequent words
are the dictionary, and all its words give the chances of one letter after
another. A candidate's runs of letters count as covered if they are a word of
the dictionary or two in a row. Without that file there is no dictionary: a
FileNotFoundError says which parameter names it.

The forest is fitted on the driver from ``N_FINDINGS`` labelled findings that
``labelled_findings`` writes by rule, behind names as well as bare in prose,
headers and URLs; their features come from the same column
expressions as those of the texts. ``fit`` takes other labelled findings.

Defined results: a null or empty text has no findings; repeated rows give
repeated findings; a null id is kept; an empty table gives an empty result;
other columns are ignored. A text is searched as a whole, whatever its length.
"""

from __future__ import annotations

import base64
import json
import os
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAMED = (
    r"(?<![A-Za-z])(?i:(?:(?:api|access|secret|private|auth|client|session|bearer|refresh|signing|encryption)[_-]?)?"
    r"(?:key|token|secret|password|passphrase|passcode|passwd|pwd|credential)s?)[\"']?\s{0,3}[:=]{1,2}>?\s{0,3}[\"']?"
)
VALUE = r"[^\s\"'<>,;]{8,}+"
TOKEN = (
    r"(?<![A-Za-z0-9+/_-])(?:eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+|(?:AKIA|ASIA)[A-Z2-7]{16}(?![A-Za-z0-9])"
    r"|(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2})"
)
HEADER = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
USER, PASSWORD = r"://[^\s/:@\"'<>]{0,64}:", r"[^\s/@\"']{3,200}(?=@[A-Za-z0-9])"
CANDIDATE = f"({NAMED})({VALUE})|({USER})({PASSWORD})|({TOKEN}|{HEADER})"
MARK = "\x01"

BEFORE, AFTER = 60, 40
#: Lines of a token in base64 and its rank. Words below are tokens of lower-case letters that begin with a space.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
DICTIONARY_WORDS, LEAST_LETTERS, MOST_LETTERS = 3000, 3, 32
NAMES = "token|secret|key|passw|passp|passc|pwd|auth|bearer|credential"
HARMLESS = (
    "commit|sha|sha1|sha256|md5|hash|checksum|digest|uuid|guid|etag|revision|rev|build|ref|id|isbn|example|sample|dummy|"
    "placeholder|fingerprint|integrity|version|src|href"
)
PREFIX = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|eyJ|glpat-|npm_|hf_|pypi-|-----BEGIN"


@cache
def vocabulary(path: str = VOCABULARY) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """The dictionary, and for each pair of letters how much likelier the second is after the first than by chance, as a logarithm."""
    words = []
    if not os.path.exists(path):
        raise FileNotFoundError(f"no vocabulary at {path}: the parameter `path` names a file of a public tokenizer, each line a token in base64 and its rank")
    with open(path, "rb") as lines:
        for token, rank in map(bytes.split, lines):
            text = base64.b64decode(token).decode("utf-8", "replace")
            word = text[1:]
            if text[:1] == " " and len(word) >= LEAST_LETTERS and word.isascii() and word.isalpha() and word.islower():
                words.append((int(rank), word))
    pairs = np.full((26, 26), 1.0)
    for _, word in words:
        codes = np.frombuffer(word.encode(), dtype=np.uint8) - ord("a")
        np.add.at(pairs, (codes[:-1], codes[1:]), 1.0)
    gain = np.log(pairs / pairs.sum(axis=1, keepdims=True)) + np.log(26)
    return tuple(w for _, w in sorted(words)[:DICTIONARY_WORDS]), tuple(np.round(gain.ravel(), 3).tolist())


def coverage(value: Column, words: tuple[str, ...]) -> Column:
    """The share of characters in runs of letters that are one or two words of the dictionary."""
    runs = F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    runs = F.filter(runs, lambda r: F.char_length(r).between(LEAST_LETTERS, MOST_LETTERS))

    def known(run: Column) -> Column:
        cuts = F.sequence(F.lit(LEAST_LETTERS), F.char_length(run))
        return F.exists(cuts, lambda i: F.forall(F.array(F.left(run, i), F.substr(run, i + 1)), lambda w: (w == "") | w.isin(*words)))

    letters = F.aggregate(F.filter(runs, known), F.lit(0), lambda n, r: n + F.char_length(r))
    return letters / F.char_length(value)


def transitions(value: Column, gain: tuple[float, ...]) -> Column:
    """The mean gain over the value's pairs of neighbouring letters, 0 without one."""
    low = F.lower(value)
    table = F.array(*[F.lit(g) for g in gain])
    code = lambda i: F.ascii(F.substr(low, i, F.lit(1))) - ord("a")
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(value) - 1, F.lit(1))), lambda i: F.struct(code(i).alias("a"), code(i + 1).alias("b")))
    pairs = F.filter(places, lambda x: x["a"].between(0, 25) & x["b"].between(0, 25))
    total = F.aggregate(pairs, F.lit(0.0), lambda t, x: t + F.element_at(table, x["a"] * 26 + x["b"] + 1))
    return F.when(F.size(pairs) > 0, total / F.size(pairs)).otherwise(0.0)


def features(value: Column, before: Column, after: Column, path: str = VOCABULARY) -> dict[str, Column]:
    """Numbers that describe a candidate, its inside and its neighbours."""
    words, gain = vocabulary(path)
    n = F.char_length(value)
    low, left, right = F.lower(value), F.lower(before), F.lower(after)

    def share(kept: str) -> Column:
        return F.char_length(F.regexp_replace(value, f"[^{kept}]", "")) / n

    def flag(col: Column, pattern: str) -> Column:
        return F.rlike(col, F.lit(pattern)).cast("double")

    return {
        "length": n.cast("double"),
        "digits": share("0-9"),
        "upper": share("A-Z"),
        "lower": share("a-z"),
        "turns": F.regexp_count(value, F.lit("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])")) / n,
        "kinds": F.size(F.array_distinct(F.split(value, ""))) / n,
        "hex": flag(value, "^[0-9a-fA-F]+$"),
        "words": coverage(value, words),
        "transitions": transitions(value, gain),
        "letters": F.char_length(F.regexp_replace(low, "[^a-z]", "")).cast("double"),
        "named": flag(left, f"({NAMES})[a-z_-]*[\"']?\\s*[:=]+>?\\s*[\"']?$"),
        "near_name": flag(left, f"({NAMES})"),
        "assigned": flag(left, "[:=]\\s*[\"']?$"),
        "quoted": flag(left, "[\"']$") * flag(right, "^[\"']"),
        "harmless": flag(left, f"(^|[^a-z])({HARMLESS})[\\W_]{{0,4}}$"),
        "path": F.regexp_count(value, F.lit("[/.]")) / n,
        "url": flag(left, "(https?:|www\\.|/)\\S*$"),
        "uuid": flag(low, "^[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}$"),
        "repeats": F.regexp_count(value, F.lit("(.)\\1\\1")) / n,
        "sequence": flag(low, "0123|1234|abcd|xxxx|\\*\\*\\*|\\$\\{|<"),
        "prefix": flag(value, f"^({PREFIX})"),
        "signed": flag(value, "^eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\."),
        "login": flag(left, "://[^\\s/:@]*:$") * flag(right, "^@"),
        "sent": flag(left, "(bearer|basic|authorization:?( token)?|x-[a-z-]*(key|token):)\\s*[\"']?$"),
    }


# --- labelled findings ----------------------------------------------------

N_FINDINGS = 5000
LETTERS = "abcdefghijklmnopqrstuvwxyz"
HEX, BASE64 = "0123456789abcdef", LETTERS + LETTERS.upper() + "0123456789+/"


def labelled_findings(seed: int = 11, n: int = N_FINDINGS, path: str = VOCABULARY) -> list[tuple[str, str, str, int]]:
    """(before, value, after, label), half of them secrets, in contexts that text and code have."""
    rng = np.random.default_rng(seed)
    known = vocabulary(path)[0]

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def chance(p: float) -> bool:
        return bool(rng.random() < p)

    def chars(alphabet: str, count: int) -> str:
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), count))

    def word() -> str:
        if rng.random() < 0.7:
            return pick(known)
        return "".join(pick(("th", "er", "an", "re", "tion", "ble", "en", "ou", "ie", "qu", "st", "la", "mo")) for _ in range(int(rng.integers(1, 5))))

    def prose() -> str:
        return " ".join(word() for _ in range(int(rng.integers(2, 8))))

    def issued() -> str:
        """A key in a format that tells who issued it."""
        many = lambda low, high: chars(BASE64[:62], int(rng.integers(low, high)))
        return pick((
            lambda: pick(("ghp_", "gho_", "ghs_", "npm_", "hf_")) + many(30, 40),
            lambda: "github_pat_" + many(20, 24) + "_" + many(40, 60),
            lambda: "glpat-" + many(18, 26),
            lambda: pick(("sk_live_", "rk_live_")) + many(20, 50),
            lambda: pick(("sk-", "sk-", "sk-proj-")) + many(32, 52),
            lambda: pick(("xoxb-", "xoxp-", "xoxa-")) + chars(BASE64[52:62], 11) + "-" + chars(BASE64[52:62], 12) + "-" + many(22, 26),
            lambda: "xoxb-" + many(22, 40),
            lambda: pick(("AKIA", "ASIA")) + chars(LETTERS.upper() + "234567", 16),
            lambda: "AIza" + chars(BASE64[:62] + "_-", 35),
            lambda: "eyJ" + base64.urlsafe_b64encode(chars(HEX, 60).encode()).decode().rstrip("="),
            lambda: ".".join(("eyJ" + many(15, 40), "eyJ" + many(20, 120), chars(BASE64[:62] + "_-", 43))),
        ))()

    def bare_secret() -> tuple[str, str, str]:
        """A secret without an assigned name: in prose, a header, a command or a URL."""
        kind = int(rng.integers(0, 10))
        if kind < 5:
            end = pick((" ", " ", "\n", "", " the key was ", " we pushed ", " use ", ": ", " (", " `", ' "', " key ", " token "))
            before, value, after = prose() * (end != "\n") + end, issued(), pick((" ", "\n", ". ", ", ", ") ", "` ", '" ', "")) + prose()
            return before[-BEFORE:] if chance(0.9) else "", value, after[:AFTER] if chance(0.9) else ""
        if kind < 7:
            before = f"{prose()} {pick(('Authorization: Bearer ', 'authorization: token ', 'Authorization: Basic ', 'X-Api-Key: ', 'x-auth-token: ', 'Bearer '))}"
            value = pick((issued, lambda: chars(BASE64[:62], int(rng.integers(24, 60))), lambda: chars(BASE64, int(rng.integers(24, 50))) + pick(("", "=", "=="))))()
            return before[-BEFORE:], value, pick(("", "'", '"', "\n")) + " " + prose()[: AFTER - 2]
        user = f"{pick(('postgres', 'mysql', 'https', 'amqp', 'redis', 'mongodb+srv', 'ftp', 'http'))}://{pick(('', word(), 'admin', 'root', 'user'))}:"
        value = pick((lambda: chars(BASE64[:62] + "!#%^&*-_", int(rng.integers(7, 24))), lambda: word() + chars("0123456789!#$", int(rng.integers(2, 5))), issued))()
        return f"{prose()} {user}"[-BEFORE:], value, f"@{pick(('db', 'localhost', word(), '10.0.0.5'))}{pick((':5432', '/', '.internal', ''))}{word()} {prose()}"[:AFTER]

    def secret() -> tuple[str, str, str]:
        if chance(0.5):
            return bare_secret()
        name = pick(("token", "api_key", "API_KEY", "secret", "password", "access_token", "auth_token", "client_secret", "apikey", "private_key"))
        value = pick((
            lambda: chars(HEX, int(pick((32, 40, 40, 48, 64)))),
            lambda: chars(BASE64[:62], int(rng.integers(20, 60))),
            lambda: chars(BASE64, int(rng.integers(24, 70))) + pick(("", "=", "==")),
            issued,
            issued,
            lambda: chars(BASE64[:62] + "!@#%^&*", int(rng.integers(10, 24))) + pick("0123456789"),
        ))()
        quote = pick(('"', '"', "'", ""))
        before = f"{prose()} {name}{pick((' = ', '=', ': ', ' := '))}{quote}"
        return before[-BEFORE:], value, f"{quote} {prose()}"[:AFTER]

    def harmless() -> tuple[str, str, str]:
        quote = pick(('"', "'", "", ""))
        kind = int(rng.integers(0, 14))
        if kind == 0:
            before, value = f"{prose()} {pick(('commit', 'commit:', 'rev', 'sha1:', 'sha256:', 'md5 =', 'checksum:', 'etag: ', 'digest='))} ", chars(HEX, int(pick((32, 40, 64))))
        elif kind == 1:
            before, value = f"{prose()} {pick(('id=', 'uuid: ', 'guid=', 'ref='))}{quote}", "-".join(chars(HEX, k) for k in (8, 4, 4, 4, 12))
        elif kind == 2:
            before, value = f"{prose()} {pick(('https://', 'src=', 'href=', 'http://www.'))}{word()}/", "/".join(word() for _ in range(5)) + str(rng.integers(100))
        elif kind == 3:
            before = f"{prose()} {pick(('token', 'api_key', 'password', 'secret', 'key'))}{pick(('=', ': ', ' = '))}{quote}"
            value = pick(("xxxxxxxxxxxxxxxxxxxx", "your_api_key_here", "YOUR-TOKEN-HERE", "changeme123", "example_password1", "********************", "${SECRET_TOKEN}", "<token_value_1>", "0123456789abcdef0123", "placeholder", "test1234test1234"))
        elif kind == 4:
            before, value = prose() + " ", "".join(word().capitalize() for _ in range(6)) + str(rng.integers(10))
        elif kind == 5:
            before, value = prose() + " ", "_".join(word() for _ in range(5)) + f"_{rng.integers(1000)}"
        elif kind == 6:
            before, value = f"{prose()} {pick(('nr. ', 'isbn ', 'order ', 'card ', ''))}", chars("0123456789", int(rng.integers(20, 30)))
        elif kind == 7:
            before, value = f"{prose()} {pick(('key', 'password', 'token', 'secret'))}{pick((': ', ' = '))}{quote}", word() + word() + word() + "s"
        elif kind == 8:  # begins like an issued key, but consists of words
            link = pick("-_")
            before = prose() + pick((" ", "\n", " `", " in ", " run "))
            value = pick(("sk-", "npm_", "hf_", "pypi-", "xoxb-", "glpat-", "ghp_", "sk_live_")) + link.join(word() for _ in range(int(rng.integers(3, 7)))) + pick(("", link)) + str(rng.integers(1, 3000))
            if chance(0.25):
                value = pick(("ASIA", "AKIA")) + ("".join(word() for _ in range(5)).upper())[:20] + str(rng.integers(1, 99))
            elif chance(0.25):
                value = pick(("ghp_", "sk_live_", "glpat-", "AKIA", "xoxb-")) + pick("xX*0") * int(rng.integers(16, 36))
        elif kind == 9:  # a digest or a number without a name
            before = prose() + pick((" ", "\n", " at ", " see ", " (", " `", " from "))
            value = pick((lambda: chars(HEX, int(pick((32, 40, 64)))), lambda: "-".join(chars(HEX, k) for k in (8, 4, 4, 4, 12)), lambda: chars("0123456789", 22)))()
        elif kind == 10:  # a place-holder for a password in a URL
            before = f"{prose()} {pick(('postgres', 'mysql', 'https', 'redis', 'amqp'))}://{pick(('user', 'username', word(), ''))}:"
            value = pick(("password", "pass", "passwd", "secret", "changeme", "xxxx", "xxxxxxxx", "****", "<password>", "${DB_PASSWORD}", "$PASSWORD", "{password}", "your_password", "PASSWORD", "pwd", "%s"))
            return before[-BEFORE:], value, f"@{pick(('host', 'localhost', word()))}/{word()} {prose()}"[:AFTER]
        elif kind == 11:  # a place-holder in a header
            before = f"{prose()} {pick(('Authorization: Bearer ', 'authorization: token ', 'X-Api-Key: '))}"
            value = pick(("your_access_token_goes_here_1", "YOUR-API-TOKEN-FROM-STEP-2", "xxxxxxxxxxxxxxxxxxxx1234", "access_token_from_response_1", "0123456789abcdef01234567", "EXAMPLE_TOKEN_0123456789"))
        elif kind == 12:  # a path or file name
            before = prose() + pick((" ", " in ", " /", "\n", " from "))
            value = pick("/_-").join(word() for _ in range(int(rng.integers(4, 8)))) + pick(("_", "-", "/", "")) + str(rng.integers(1, 3000))
        else:
            before, value = f"{prose()} {pick(('integrity=', 'fingerprint: ', 'hash: ', 'version='))}{quote}", chars(BASE64, int(rng.integers(28, 60)))
        return before[-BEFORE:], value, f"{quote} {prose()}"[:AFTER]

    return [(*(secret() if i % 2 else harmless()), i % 2) for i in range(n)]


# --- random forest --------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    names: tuple[str, ...]
    trees: tuple

    def sql(self, prefix: str = "") -> str:
        """The share of secrets over the leaves that a candidate reaches, as SQL."""

        def tree(node) -> str:
            if isinstance(node, float):
                return f"{node:.6f}D"
            name, cut, low, high = node
            return f"CASE WHEN {prefix}{name} <= {cut!r}D THEN {tree(low)} ELSE {tree(high)} END"

        return "(" + " + ".join(tree(t) for t in self.trees) + f") / {float(len(self.trees))!r}D"

    def score(self, rows: np.ndarray) -> np.ndarray:
        place = {name: i for i, name in enumerate(self.names)}

        def tree(node, row) -> float:
            while not isinstance(node, float):
                node = node[2] if row[place[node[0]]] <= node[1] else node[3]
            return node

        return np.array([sum(tree(t, row) for t in self.trees) / len(self.trees) for row in rows])


def fit_forest(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], trees: int = 15, depth: int = 6, seed: int = 5) -> Forest:
    """Bootstrapped trees; each node takes the best Gini split over a random third of the features."""
    rng = np.random.default_rng(seed)

    def grow(rows: np.ndarray, left: int):
        labels = y[rows]
        rate = float(labels.mean())
        if not left or len(rows) < 10 or rate in (0.0, 1.0):
            return rate
        best = (2 * rate * (1 - rate) * len(rows) - 1e-9, None, 0.0)
        for col in rng.choice(x.shape[1], size=max(1, x.shape[1] // 3), replace=False):
            values = np.unique(x[rows, col])
            if len(values) < 2:
                continue
            for cut in np.unique(np.quantile(values, np.linspace(0, 1, 18)[1:-1])) if len(values) > 2 else values[:1]:
                low = x[rows, col] <= cut
                k = int(low.sum())
                if not 3 <= k <= len(rows) - 3:
                    continue
                a, b = labels[low].mean(), labels[~low].mean()
                cost = 2 * a * (1 - a) * k + 2 * b * (1 - b) * (len(rows) - k)
                if cost < best[0]:
                    best = (cost, int(col), float(cut))
        if best[1] is None:
            return rate
        low = x[rows, best[1]] <= best[2]
        return (names[best[1]], best[2], grow(rows[low], left - 1), grow(rows[~low], left - 1))

    return Forest(names, tuple(grow(rng.integers(0, len(y), len(y)), depth) for _ in range(trees)))


_fitted: dict[tuple[int, int, str], Forest] = {}


def fit(spark: SparkSession, findings: list[tuple[str, str, str, int]], path: str = VOCABULARY) -> Forest:
    """A forest from labelled findings (before, value, after, label), a bounded list."""
    text = json.dumps([dict(zip(("before", "value", "after", "label"), f, strict=True)) for f in findings])
    rows = spark.range(1).select(
        F.inline(F.from_json(F.lit(text), "array<struct<before:string,value:string,after:string,label:int>>"))
    )
    columns = features(F.col("value"), F.col("before"), F.col("after"), path)
    table = rows.select("label", *[c.alias(name) for name, c in columns.items()]).collect()  # one row a finding
    data = np.array([list(r) for r in table], dtype=float)
    return fit_forest(data[:, 1:], data[:, 0], tuple(columns))


def trained_forest(spark: SparkSession, seed: int = 11, n: int = N_FINDINGS, path: str = VOCABULARY) -> Forest:
    if (seed, n, path) not in _fitted:
        _fitted[seed, n, path] = fit(spark, labelled_findings(seed, n, path), path)
    return _fitted[seed, n, path]


# --- scanning -------------------------------------------------------------


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, value, before, after): every candidate and its neighbours; start counts code points."""
    text = F.col(text_col)
    marked = F.regexp_replace(F.translate(text, MARK, " "), F.lit(CANDIDATE), F.lit(f"$1$3{MARK}$2$4$5{MARK}"))
    found = docs.where(F.rlike(text, F.lit(CANDIDATE))).select(F.col(id_col).alias("id"), F.split(marked, MARK, -1).alias("p"))

    # Places of all pieces; then neighbours from as many pieces as can fill them, candidates of eight characters or more among them.
    ends = F.aggregate("p", F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.char_length(x))))
    left, right = 2 * (BEFORE // 8) + 3, 2 * (AFTER // 8) + 3

    def one(i: Column) -> Column:
        first = F.greatest(i - left, F.lit(0))
        return F.struct(
            F.get("ends", i).alias("start"),
            F.get("p", i).alias("value"),
            F.right(F.array_join(F.slice("p", first + 1, i - first), ""), F.lit(BEFORE)).alias("before"),
            F.left(F.array_join(F.slice("p", i + 2, F.lit(right)), ""), F.lit(AFTER)).alias("after"),
        )

    found = found.withColumn("ends", ends)
    return found.select("id", F.inline(F.transform(F.sequence(F.lit(1), F.size("p") - 2, F.lit(2)), one)))


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, forest: Forest | None = None, path: str = VOCABULARY
) -> DataFrame:
    """(id, start, length, kind, value, score) of the candidates that the forest keeps."""
    forest = forest or trained_forest(docs.sparkSession, path=path)
    found = candidates(docs, id_col, text_col)
    columns = features(F.col("value"), F.col("before"), F.col("after"), path)
    scored = found.select("id", "start", "value", *[c.alias(f"f_{name}") for name, c in columns.items()])
    header = F.col("value").startswith("-----BEGIN")
    kind = F.when(header, "private_key").when(F.col("f_named") > 0, "assigned").when(F.col("f_login") > 0, "login").otherwise("token")
    score = F.when(header, 1.0).otherwise(F.expr(forest.sql("f_")))
    return scored.select("id", "start", F.char_length("value").cast("long").alias("length"), kind.alias("kind"), "value", score.alias("score")).where(
        F.col("score") >= threshold
    )


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every secret found; the value itself leaves as a digest only."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_secrets(docs).select(
        F.col("id").alias("doc_id"), "start", "length", "kind", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.round("score", 6).alias("score")
    )
