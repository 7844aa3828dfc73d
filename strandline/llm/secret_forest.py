"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are runs of characters of keys and tokens (of ``SHORTEST`` characters with a digit, or of ``LETTERS`` with
capitals inside), whatever of ``VALUE`` characters or more is assigned to a name of a secret or said to be one,
passwords in addresses, and the heads of private keys.  The patterns are wide; what counts is
left to the forest.  It looks at a candidate's length, its character transitions, how much of it dictionary words cover, the
path of its document and the words beside it.

The dictionary is the corpus's own: the ``DICTIONARY`` commonest words of its texts.  From these come the
transitions, too: how likely each letter follows the one before.  Which words beside a candidate and in its path
speak for or against a secret is learned from the labelled findings, with the forest.  Findings are lines with
their path and the secret in them, if any, a bounded table.  Forest, words and transitions become one SQL expression,
so scanning is DataFrame operations only.

``seed_findings`` writes the labelled findings that the query trains on: settings, code, addresses, headers and prose in
which keys and passwords are given, and in which what is commonly mistaken for them stands.  With findings
of your own, pass those to ``train`` instead.

Rows: null and empty texts have no candidates.  A null path is an empty one, a null doc_id is carried
through.  Repeated rows give repeated findings, and so do candidates that are repeated in a word.  Extra columns
are ignored.  Findings without both labels train a forest that gives the share of label 1; without any it is 0.
"""

from __future__ import annotations

import math
import random
import string
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import SPACES, table

SHORTEST, LETTERS, VALUE = 12, 20, 6
DICTIONARY, NEIGHBOURS = 4096, 200
TREES, DEPTH, LEAF = 24, 6, 2
CUTOFF = 0.5
_CHARS = r"A-Za-z0-9+/_\-"
_NAME = r"(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|key|pin|auth|credentials?)[A-Za-z0-9_]{0,12}+[\"'`]?"
_OPEN = r"[\"'`(\[{]*+"
_BODY = rf"[^\s\"'`,;)\]}}@]{{{VALUE},}}+"
#: What stands before a value in its own word: a secret's name and a sign, or an address's user.
_BEFORE = rf"(?:{_NAME}(?:=>|:=|=|:){_OPEN}|://[^\s/:@]{{1,64}}+:|://(?=[^\s/:@]{{{VALUE},}}+@))"
_RUN = rf"(?<![{_CHARS}])eyJ[A-Za-z0-9_\-]++(?:\.[A-Za-z0-9_\-]++)++|(?<![{_CHARS}])(?=[A-Za-z+/_\-]*+[0-9])[{_CHARS}]{{{SHORTEST},}}+={{0,2}}|(?<![{_CHARS}])(?=[{_CHARS}]*?[a-z][A-Z])[{_CHARS}]{{{LETTERS},}}+={{0,2}}"
#: Runs are tried only where they begin, so a scan is linear however long a run is.
CANDIDATE = rf"{_BEFORE}{_BODY}|{_RUN}"
#: What stands in the words before a value.
_GIVEN = rf"{_NAME}\s*(?:=>|:=|=|:|\sis)$|--?{_NAME}$"
_LEADS = r"(?:[:=]>?|^is)$|^--?[A-Za-z]"
_ANYWHERE = rf"(?:{_NAME}\s*(?:=>|:=|=|:|\sis)|--?{_NAME})\s+{_OPEN}{_BODY}"
_PEM = "-----BEGIN"
FEATURES = ["length", "digits", "capitals", "signs", "changes", "transitions", "cover", "variety", "hexadecimal", "runs", "assigned", "quoted", "near_for", "near_against", "after_for", "after_against", "path_for", "path_against"]


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The ``size`` commonest words of four letters or more, over all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}{4,40}+"), 0)).alias("w"))
    return [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()]


def _letter(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0


def transitions(words: list[str]) -> list[float]:
    """log10 P(letter | letter before), 27 x 27 in a row; 0 is any other character."""
    n = np.ones((27, 27))
    for w in words:
        for a, b in zip(w, w[1:]):
            n[_letter(a), _letter(b)] += 1
    return np.log10(n / n.sum(1, keepdims=True)).ravel().tolist()


@dataclass
class Scanner:
    """What scanning needs: words, their transitions, neighbours that speak for and against, and the forest."""

    words: list[str]
    neighbours: dict[str, list[str]] = field(default_factory=dict)
    forest: Forest | None = None

    def features(self, found: DataFrame) -> DataFrame:
        """``found`` with FEATURES; it has candidate, prefix (what stands before it in its word), before, after and path."""
        c, n = F.col("candidate"), F.length("candidate")
        low = F.lower("candidate")
        share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
        letters = F.split(low, "")
        code = lambda x: F.when((x >= "a") & (x <= "z") & (F.length(x) == 1), F.ascii(x) - 96).otherwise(0)
        table_ = F.array(*[F.lit(x) for x in transitions(self.words)])
        steps = F.zip_with(F.slice(letters, 1, F.greatest(n - 1, F.lit(0))), F.slice(letters, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.get(table_, code(a) * 27 + code(b)))
        # the letters of a candidate, cut at other signs and before capitals
        parts = F.regexp_extract_all(c, F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+"), 0)
        known = F.filter(parts, lambda x: F.lower(x).isin(self.words) if self.words else F.lit(False))
        made = {
            "length": n,
            "digits": share("[0-9]"),
            "capitals": share("[A-Z]"),
            "signs": share(rf"[^{_CHARS}]"),
            "changes": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
            "transitions": F.aggregate(steps, F.lit(0.0), lambda x, y: x + y) / F.greatest(n - 1, F.lit(1)),
            "cover": F.aggregate(known, F.lit(0), lambda x, y: x + F.length(y)) / n,
            "variety": F.size(F.array_distinct(letters)) / n,
            "hexadecimal": low.rlike("^[0-9a-f]+$").cast("int"),
            "runs": F.regexp_count(c, F.lit(r"(.)\1{2,}")),
            "assigned": F.concat_ws(" ", "before", "prefix").rlike("(?:[=:]>?|\\sis)[\\s\"'`]*$").cast("int"),
            "quoted": F.col("prefix").rlike("[\"'`]$").cast("int"),
        }
        for name, beside in (("near", F.concat_ws(" ", "before", "prefix")), ("after", F.col("after")), ("path", F.coalesce("path", F.lit("")))):
            tokens = F.regexp_extract_all(F.lower(beside), F.lit("[a-z]{2,}"), 0)
            for side in ("for", "against"):
                made[f"{name}_{side}"] = _among(tokens, self.neighbours.get(f"{name}_{side}", []))
        return found.withColumns({k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in made.items()})


def _among(tokens: Column, words: list[str]) -> Column:
    """How many of the tokens are among the words."""
    return F.size(F.filter(tokens, lambda x: x.isin(words))) if words else F.lit(0)


def _sides(rows: list, text, least: int = 6) -> tuple[list[str], list[str]]:
    """Words beside the candidates that stand by secrets, or by others, at least three times as often as their share."""
    by, n = (Counter(), Counter()), [1, 1]
    for r in rows:
        n[r["label"]] += 1
        by[r["label"]].update(set("".join(x if "a" <= x <= "z" else " " for x in (text(r) or "").lower()).split()))
    odds = {w: math.log((by[1][w] + 1) / (n[1] + 2)) - math.log((by[0][w] + 1) / (n[0] + 2)) for w in by[0].keys() | by[1].keys() if by[0][w] + by[1][w] >= least and len(w) > 1}
    order = sorted(odds, key=lambda w: (-abs(odds[w]), w))[:NEIGHBOURS]
    return sorted(w for w in order if odds[w] >= math.log(3)), sorted(w for w in order if odds[w] <= -math.log(3))


_WORDS = "user account build release server client order invoice table page image request response session cache queue worker report item field value index width height margin color status update create delete handler service module package example sample default object string number method class result buffer stream header footer button label input output".split()


def seed_findings(n: int = 4000, seed: int = 5) -> list[tuple[str, str, str | None]]:
    """(line, path, secret or None): half with a secret in one of many forms, half with what is mistaken for one."""
    rng = random.Random(seed)
    some = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    pick = rng.choice
    hexes, alnum, upper = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    word = lambda: pick(_WORDS)
    prose = lambda: " ".join(word() for _ in range(rng.randint(1, 4)))
    uuid = lambda: "-".join(some(hexes, k) for k in (8, 4, 4, 4, 12))
    camel = lambda: word() + "".join(word().capitalize() for _ in range(rng.randint(2, 4)))
    code_path = lambda: pick([f"src/{word()}/{word()}.py", f"{word()}/{word()}.js", f"config/{word()}.yml", ".env", f"deploy/{word()}.sh", f"{word()}.json", "settings.ini", "", f"{word()}"])
    low_path = lambda: pick([f"tests/test_{word()}.py", "docs/guide.md", f"examples/{word()}.py", "yarn.lock", "package-lock.json", f"fixtures/{word()}.json", "", f"{word()}"])
    values = [
        lambda: some(hexes, pick([32, 40, 40, 64])),
        lambda: some(alnum, rng.randint(16, 44)),
        lambda: some(alnum + "+/", 40) + pick(["", "=", "=="]),
        lambda: pick(["AKIA", "ASIA"]) + some(upper, 16),
        lambda: pick(["ghp_", "gho_", "sk_live_", "rk_live_", "glpat-", "AIza", "npm_", "xoxb-"]) + some(alnum, rng.randint(20, 36)),
        lambda: "eyJ" + some(alnum, rng.randint(20, 40)) + "." + some(alnum + "_-", rng.randint(30, 60)),
    ]
    passwords = [
        lambda: some(alnum + "!#$%&*+?^", rng.randint(8, 16)),
        lambda: word().capitalize() + some(string.digits, rng.randint(2, 4)) + pick("!?#$%*"),
        lambda: "-".join(pick([word(), some(string.ascii_lowercase, rng.randint(4, 7))]) for _ in range(rng.randint(3, 4))) + pick(["", some(string.digits, 2)]),
        lambda: some(hexes, 8) + pick(["", some(hexes, 4)]),
        lambda: some(string.ascii_letters, rng.randint(10, 24)),
    ]
    names = ["password", "passwd", "pwd", "token", "secret", "api_key", "auth_token", "access_key", "client_secret", "secret_key", "DB_PASSWORD", "API_TOKEN", "pin", "passphrase", "private_key", "apiKey", "accessToken"]
    out = []
    for _ in range(n // 2):
        strong = rng.random() < 0.6
        value, name, q = pick(values if strong else passwords)(), pick(names), pick(['"', "'"])
        forms = [
            f"{name}={value}",
            f"export {name.upper()}={q}{value}{q}",
            f"{name}: {value}",
            f"{name} = {q}{value}{q}",
            f'"{name}": "{value}",',
            f"{name} := {q}{value}{q};",
            f"{word()}({name}={q}{value}{q}, {word()}=1)",
            f"the {name} is {value}",
            f"my {name} is {value} {prose()}",
            f"{prose()} {name} => {q}{value}{q}",
            f"postgres://{word()}:{value}@{word()}.internal:5432/{word()}",
            f"https://{word()}:{value}@{word()}.example.org/{word()}",
        ]
        if strong:
            forms += [f"Authorization: Bearer {value}", f"{prose()} {value} {prose()}", f"curl -H {q}X-Api-Key: {value}{q}", f"{word()} --{name} {value}", f"git clone https://{value}@{word()}.org/{word()}", f"{value}"]
        line = pick(forms)
        if rng.random() < 0.03:
            line, value = f"-----BEGIN {pick(['RSA ', 'EC ', 'OPENSSH ', ''])}PRIVATE KEY-----", _PEM
        elif "://" in line:  # a slash would end it there
            line, value = line.replace(value, value.replace("/", "_")), value.replace("/", "_")
        out.append((f"{prose()} {line}" if rng.random() < 0.3 else line, code_path() if rng.random() < 0.9 else low_path(), value))
    for _ in range(n - n // 2):
        name, q = pick(names), pick(['"', "'", ""])
        hollow = pick(["********", "xxxxxxxxxxxx", "changeme", "${SECRET_VALUE}", "<your-token-here>", "YOUR_API_KEY", "example_password", "placeholder", "REDACTED", "os.environ.get(NAME)", "process.env.TOKEN", "getpass.getpass()", "test1234", "password123", "undefined", "required", "optional", "{{ vault_token }}", "AAAAAAAAAAAAAAA1", "123456789012", "000000000000"])
        line = pick(
            [
                f"{name} = {q}{hollow}{q}",
                f"{name}: {hollow}",
                f"{name}={camel()}()",
                f"{name}: {word()} {prose()}",
                f"primary_key={word()}_{word()}_id",
                f"keyboard: {word()}",
                f"the key is {pick(['important', 'hidden', 'always', 'simple', 'patience'])} {prose()}",
                f"token = {camel()}",
                f"commit {some(hexes, 40)}",
                f"sha256:{some(hexes, 64)}",
                f'integrity="sha512-{some(alnum + "+/", 86)}=="',
                f"md5 {some(hexes, 32)} {word()}.tar.gz",
                f"id={uuid()}",
                f"{prose()} {uuid()}",
                f"order {some(string.digits, 16)}",
                f"card no. {some(string.digits, 16)} {prose()}",
                f"{prose()} {some(string.digits, pick([13, 14, 15, 16, 19]))} {prose()}",
                f"phone +{some(string.digits, rng.randint(11, 14))}",
                f"version {rng.randint(0, 9)}-{rng.randint(0, 20)}-rc{rng.randint(1, 9)}-{some(string.digits, 8)}",
                f"href=/{'/'.join(word() for _ in range(rng.randint(2, 5)))}/{rng.randint(1, 9999)}",
                f"https://{word()}.org/{word()}/{word()}-{word()}-{rng.randint(1, 99999)}",
                f"{camel()}{rng.randint(0, 99)}",
                f"{prose()} {camel()} {prose()}",
                f"IMG_{rng.randint(1990, 2030)}{some(string.digits, 4)}_{some(string.digits, 6)}",
                f"{rng.randint(1970, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{some(string.digits, 6)}",
                f"src=data:image/png;base64,{some(alnum + '+/', rng.randint(40, 90))}",
                f"{word()}_{word()}_{word()}_{rng.randint(1, 99)}",
                f"checksum {some(hexes, 40)}",
                f"ISBN 978-{some(string.digits, 10)}",
                f"http://{word()}:{rng.randint(100000, 999999)}/{word()}",
            ]
        )
        out.append((f"{prose()} {line}" if rng.random() < 0.3 else line, pick([code_path, low_path])(), None))
    return out


_Node = float | tuple[int, float, "_Node", "_Node"]


class Forest:
    """Classification trees on bootstrap samples; each split looks at a random third of the features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees: list[_Node] = []
        for _ in range(TREES):
            own = rng.integers(0, len(y), len(y)) if len(y) else np.zeros(0, int)
            self.trees.append(self._grow(x[own], y[own], DEPTH, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator) -> _Node:
        share = float(y.mean()) if len(y) else 0.0
        if not depth or len(y) < 2 * LEAF or share in (0.0, 1.0):
            return share
        best, cut = share * (1 - share) - 1e-9, None
        for k in sorted(rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False).tolist()):
            order = np.argsort(x[:, k], kind="stable")
            v, ones = x[order, k], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            at = at[(at + 1 >= LEAF) & (len(y) - at - 1 >= LEAF)]
            if not len(at):
                continue
            left, right = ones[at] / (at + 1), (ones[-1] - ones[at]) / (len(y) - at - 1)
            impurity = ((at + 1) * left * (1 - left) + (len(y) - at - 1) * right * (1 - right)) / len(y)
            if impurity.min() < best:
                b = int(impurity.argmin())
                best, cut = float(impurity[b]), (k, float((v[at[b]] + v[at[b] + 1]) / 2))
        if cut is None:
            return share
        low = x[:, cut[0]] <= cut[1]
        return (*cut, self._grow(x[low], y[low], depth - 1, rng), self._grow(x[~low], y[~low], depth - 1, rng))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def one(node: _Node, row: np.ndarray) -> float:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            return node

        return np.array([sum(one(t, row) for t in self.trees) / len(self.trees) for row in x])

    def expression(self) -> Column:
        """The mean of the trees as SQL over FEATURES."""

        def sql(node: _Node) -> str:
            return f"CASE WHEN {FEATURES[node[0]]} <= {node[1]!r}D THEN {sql(node[2])} ELSE {sql(node[3])} END" if isinstance(node, tuple) else f"{node!r}D"

        return F.expr("(" + " + ".join(map(sql, self.trees)) + f") / {len(self.trees)}D")


def train(findings: DataFrame, words: list[str]) -> Scanner:
    """A scanner from labelled lines: text, path and secret (null: there is none); a bounded table.  ``words``: the dictionary."""
    lines = findings.where("text IS NOT NULL").withColumn("doc_id", F.struct("text", "path", "secret"))
    found = candidates(lines, path="path").select("*", F.coalesce(F.col("candidate") == F.col("doc_id.secret"), F.lit(False)).cast("int").alias("label"))
    rows = found.select("candidate", "prefix", "before", "after", "path", "label").collect()
    scanner = Scanner(words)
    for name, text in (("near", lambda r: f"{r['before']} {r['prefix']}"), ("after", lambda r: r["after"]), ("path", lambda r: r["path"])):
        scanner.neighbours[f"{name}_for"], scanner.neighbours[f"{name}_against"] = _sides(rows, text)
    data = sorted(tuple(r) for r in scanner.features(found).select(*FEATURES, F.col("label").cast("double")).collect())
    data = np.array(data, float).reshape(len(data), len(FEATURES) + 1)
    scanner.forest = Forest(data[:, :-1], data[:, -1])
    return scanner


def candidates(docs: DataFrame, text: str = "text", path: str = "source") -> DataFrame:
    """doc_id, word (its number), nth (candidate of the word), candidate, prefix, before, after, path."""
    t = F.col(text)
    some = docs.where(t.rlike(CANDIDATE) | t.rlike(_ANYWHERE) | t.contains(_PEM)).select("doc_id", F.col(path).cast("string").alias("path"), F.split(t, SPACES).alias("w"))
    n = F.size("w")
    back = lambda k: F.concat(F.array_repeat(F.lit(""), k), F.slice("w", 1, F.greatest(n - k, F.lit(0))))
    ahead = lambda k: F.concat(F.slice("w", k + 1, F.greatest(n - k, F.lit(0))), F.array_repeat(F.lit(""), k))
    zipped = F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("i"), F.col("w").alias("w"), back(1).alias("p1"), back(2).alias("p2"), back(3).alias("p3"), ahead(1).alias("n1"), ahead(2).alias("n2"), ahead(3).alias("n3"))
    given = lambda x: x["p1"].rlike(_LEADS) & F.concat_ws(" ", x["p2"], x["p1"]).rlike(_GIVEN) & x["w"].rlike(rf"^{_OPEN}{_BODY}")
    hits = F.filter(zipped, lambda x: x["w"].rlike(CANDIDATE) | (x["w"] == _PEM) | given(x))
    words = some.select("doc_id", "path", F.explode(hits).alias("x"))
    x = F.col("x")
    words = words.select("doc_id", "path", F.col("x.i").alias("word"), F.col("x.w").alias("w"), F.btrim(F.concat_ws(" ", "x.p3", "x.p2", "x.p1")).alias("before"), F.btrim(F.concat_ws(" ", "x.n1", "x.n2", "x.n3")).alias("after"), given(x).alias("given"))
    # each match with what stands before it: the pieces between matches, and the matches so far
    matches, gaps = F.regexp_extract_all("w", F.lit(CANDIDATE), 0), F.split("w", CANDIDATE, -1)
    upto = lambda i: F.array_join(F.flatten(F.zip_with(F.slice(gaps, 1, i + 1), F.concat(F.slice(matches, 1, i), F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    inside = F.transform(matches, lambda m, i: F.struct(F.regexp_replace(m, f"^{_BEFORE}", "").alias("candidate"), F.concat(upto(i), F.regexp_extract(m, f"^{_BEFORE}", 0)).alias("prefix")))
    opening = F.regexp_extract("w", f"^{_OPEN}", 0)
    whole = F.array(F.struct(F.regexp_extract("w", rf"^{_OPEN}({_BODY})", 1).alias("candidate"), opening.alias("prefix")))
    head = F.array(F.struct(F.col("w").alias("candidate"), F.lit("").alias("prefix")))
    found = F.when(F.col("w") == _PEM, head).when(F.col("given"), whole).otherwise(inside)
    each = words.select("*", F.posexplode(found).alias("nth", "c"))
    return each.select("doc_id", F.col("word").cast("long").alias("word"), F.col("nth").cast("long").alias("nth"), "c.candidate", "c.prefix", "before", "after", "path")


def scan(docs: DataFrame, scanner: Scanner, text: str = "text", path: str = "source") -> DataFrame:
    """Every candidate with its score and whether the forest takes it for a secret."""
    scored = scanner.features(candidates(docs, text, path)).withColumn("score", scanner.forest.expression())
    return scored.select("doc_id", "word", "nth", "candidate", "score", (F.col("score") >= CUTOFF).alias("is_secret"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    findings = spark.createDataFrame(seed_findings(), "text string, path string, secret string")
    return scan(docs, train(findings, dictionary(docs)))


QUERIES = {"op4_secret_forest": op4_secret_forest}
ORACLES: dict[str, str] = {}
