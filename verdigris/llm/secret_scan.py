"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are private key blocks, each as a whole, values after an assignment to a
name, with or without digits and up to their quote if they are in quotes (of any
characters but white space then), and
unbroken runs of 16 letters, digits and few signs or more with at least a digit;
all are taken whole, however long they are. Features: length, entropy, shares and transitions of character classes,
coverage by a dictionary, path look, paths and other words before. The forest is
trained in numpy on labelled findings: the caller's, as (value, name, text before,
secret or not), or, as no given table labels any, those that a seeded generator draws
from the formats of credentials on one side and of look-alikes (hashes under revision
control, identifiers, addresses, paths, versions, words, numbers, placeholders) on the other.

Every whole text is searched; findings never carry the secret itself but its
hash. Null and empty texts have none. Repeated rows repeat their findings. An
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._shared import ship, small_batches, table

CANDIDATE = re.compile(
    r"(?P<block>-----BEGIN (?P<kind>[A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?)-----[^-]*+(?:-(?!----)[^-]*+)*+-----END (?P=kind)-----)"
    r"|(?P<name>[A-Za-z][A-Za-z0-9_.-]{0,40}+)[\"']?\s{0,3}(?:=|:|:=|=>)\s{0,3}(?:(?P<quote>[\"'])(?P<quoted>[^\s\"'\\]{8,}+)(?P=quote)|[\"']?(?P<value>[A-Za-z0-9+/_=.$!@#%^&*~-]{8,}+))"
    r"|(?<![A-Za-z0-9+/_=.@-])(?P<bare>(?=[A-Za-z+/_=.-]*+[0-9])[A-Za-z0-9+/_=.-]{16,}+)(?![A-Za-z0-9@])"
)
#: Words before a value that speak for or against a secret.
FOR = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "access", "auth", "bearer", "credential", "private", "authorization")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "digest", "revision", "uuid", "guid", "id", "version", "build", "path", "file", "url", "href", "src", "mail", "email", "image", "example")
#: Starts of known credential formats.
STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "glpat-", "eyJ", "SG.", "npm_")
#: A small dictionary of word pieces.
DICTIONARY = (
    "test", "example", "name", "user", "data", "file", "path", "home", "main", "index", "page", "image", "http", "https", "html", "www", "com", "org", "net", "mail", "info", "node", "list", "table",
    "value", "string", "config", "default", "project", "version", "release", "build", "server", "client", "local", "host", "public", "static", "assets", "style", "script", "module", "class", "function",
    "tion", "ing", "ment", "able", "the", "and", "for", "with", "that", "this", "from", "your", "have", "more", "when", "what", "about", "which", "their", "will", "each", "other", "were", "ness", "ally",
)
#: Parts of paths where secrets lie, and where examples do.
PATHS_FOR = (".env", "config", "credential", "secret", ".pem", ".key", ".npmrc", "deploy", "settings", "vault")
PATHS_AGAINST = ("test", "example", "sample", "fixture", "doc", "readme", "lock", "node_modules", "vendor", "mock", "template")
PATH = re.compile(r"(?:[\w.-]+/)+[\w.-]+|\b[\w-]*\.(?:env|pem|key|py|js|ts|json|ya?ml|toml|ini|cfg|conf|lock|md|rst|txt|html?|sh)\b")
THRESHOLD = 0.5
FEATURES = 26
BEFORE = 80


def features(value: str, name: str, before: str) -> list[float]:
    """Numbers about a value, the name that it is assigned to, and the text before it."""
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    counts = {c: value.count(c) for c in set(value)}
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    hexadecimal = all(c in "0123456789abcdefABCDEF" for c in value)
    low = value.lower()
    covered = bytearray(n)
    for w in DICTIONARY:
        at = low.find(w)
        while at >= 0:
            covered[at : at + len(w)] = b"\x01" * len(w)
            at = low.find(w, at + 1)
    vowels = sum(c in "aeiou" for c in low) / n
    paths = " ".join(PATH.findall(before.lower()))
    words = set(re.findall(r"[a-z]+", PATH.sub(" ", before[-40:].lower())))
    named = name.lower()
    runs = max((len(r) for r in re.findall(r"[a-z]+|[A-Z]+|\d+", value)), default=0) / n
    return [
        min(n, 200), entropy, entropy / math.log2(max(2, n)), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("s") / n, changes, float(hexadecimal),
        float(hexadecimal and n in (32, 40, 64)), sum(covered) / n, vowels, runs, value.count("/") / n, value.count(".") / n, value.count("-") / n, float(bool(re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", low))),
        float(any(w in named for w in FOR)), float(any(w in re.split(r"[^a-z0-9]+", named) for w in AGAINST)), float(any(w in words for w in FOR)), float(any(w in words for w in AGAINST)), float(value.startswith(STARTS)),
        float(bool(paths)), float(any(w in paths for w in PATHS_FOR)), float(any(w in paths for w in PATHS_AGAINST)), float(value.startswith("-----BEGIN ")),
    ]


def labelled_findings(n: int = 4000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of drawn findings, half of them secrets."""
    rng = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexa, wide, both = digits + "abcdef", letters + letters.upper() + digits, letters + letters.upper()

    def draw(alphabet: str, k: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(k))

    def word() -> str:
        return rng.choice(DICTIONARY) if rng.random() < 0.6 else draw("aeiou", 1).join(draw("bcdfghklmnprst", 1) for _ in range(rng.randint(2, 4)))

    good_names, bad_names = ("token", "api_key", "secret", "password", "access_token", "auth", "client_secret", "key", "TOKEN", "private_key"), ("commit", "sha1", "md5", "checksum", "id", "version", "path", "url", "file", "build", "class", "name", "color", "")
    good_paths, bad_paths = ("config/prod.env", "deploy/settings.yaml", ".npmrc", "home/app/.env", "secrets/service.json"), ("tests/fixtures/sample.json", "docs/readme.md", "examples/demo.py", "package.lock", "vendor/lib/index.js")

    def block(body: str) -> str:
        kind = rng.choice(("PRIVATE KEY", "RSA PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"))
        return f"-----BEGIN {kind}-----\n{body}\n-----END {kind}-----"

    rows, labels = [], []
    for i in range(n):
        secret = i % 2
        place = rng.choice((*good_paths, *bad_paths[:1]) if secret else (*bad_paths, *good_paths[:1])) if rng.random() < 0.2 else ""
        if secret:
            form = rng.randrange(12)
            value = [draw(hexa, rng.choice((32, 40, 40, 40, 64))), draw(wide, rng.randint(20, 64)), rng.choice(STARTS) + draw(wide, rng.randint(16, 40)), draw(wide + "+/", rng.randint(24, 88)) + "=" * rng.randint(0, 2),
                     draw(wide + "!@#$%", rng.randint(10, 24)), "eyJ" + draw(wide, 30) + "." + draw(wide, 40) + "." + draw(wide + "_-", 43), draw(wide + "_-", rng.randint(24, 48)),
                     "-".join(word() for _ in range(rng.randint(3, 5))), draw(both + "!@#$%" * rng.randint(0, 1), rng.randint(12, 40)), "eyJ" + ".".join(draw(wide + "_-", rng.randint(40, 500) if form == 9 else 1) for _ in range(3)),
                     block("\n".join(draw(wide + "+/", 64) for _ in range(rng.randint(3, 25) if form == 10 else 1))), draw(wide + "(){}[]<>;:,?|!@#$%", rng.randint(10, 28))][form]
            name = "" if form == 10 else rng.choice(good_names) if form not in (2, 5, 9) or rng.random() < 0.5 else ""
            before = " ".join([place, word(), word(), name or rng.choice(("", "Bearer"))])
        else:
            form = rng.randrange(16)
            value = [draw(hexa, rng.choice((32, 40, 64))), "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)), "/".join(word() for _ in range(rng.randint(3, 6))) + str(rng.randrange(99)), ".".join([word(), word(), "com"]) + "/" + word() + draw(digits, 3),
                     word() + "-" + word() + "-" + draw(digits, rng.randint(2, 8)), draw(digits, rng.randint(16, 24)), "".join(word() for _ in range(rng.randint(4, 7))) + draw(digits, rng.randint(1, 3)),
                     "_".join(word().upper() for _ in range(4)) + draw(digits, 2), word() + "." + draw(digits, 2) + "." + word() + draw(digits, 1) + ".example.com",
                     "".join(word() for _ in range(rng.randint(2, 4))).capitalize() if rng.random() < 0.3 else "".join(word() for _ in range(rng.randint(2, 4))), rng.choice("._").join(word() for _ in range(rng.randint(2, 4))), "-".join(word() for _ in range(rng.randint(2, 5))), draw(wide + "+/", rng.randint(200, 900) if form == 12 else 1),
                     block(rng.choice(("...", "your key here", "<key>", "example", "xxxxxxxxxxxxxxxx"))) if form == 13 else "", "https://" + ".".join([word(), word(), "org"]) + "/" + "/".join(word() for _ in range(rng.randint(1, 4))) + rng.choice(("", "?id=" + draw(digits, 4), ".html")),
                     rng.choice(("${%s}", "{{%s}}", "<%s>", "$(%s)", "%s(%s)")).replace("%s", word() + rng.choice("._") + word())][form]
            name = "" if form == 13 else rng.choice((*bad_names, word(), word().capitalize())) if form in (0, 1, 11, 12) or rng.random() < 0.7 else rng.choice(good_names)
            before = " ".join([place, word(), rng.choice(("commit", "revision", "file", "see", "at", "id", word())) if form != 12 else rng.choice(("image", "src", "href")), name])
        rows.append(features(value, name, before))
        labels.append(secret)
    return np.array(rows), np.array(labels)


class Forest:
    """Trees as arrays: feature, cut, left and right child, and the share of secrets at each node."""

    def __init__(self, trees: int = 25, depth: int = 9, least: int = 4, seed: int = 5):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed
        self.grown: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list] = []

            def grow(own: np.ndarray, depth: int) -> int:
                at = len(nodes)
                share = float(y[own].mean())
                nodes.append([-1, 0.0, -1, -1, share])
                if depth == self.depth or len(own) < 2 * self.least or share in (0.0, 1.0):
                    return at
                best = (share * (1 - share) * len(own) - 1e-9, None, 0.0)
                for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
                    order = own[np.argsort(x[own, f], kind="stable")]
                    v, hits = x[order, f], np.cumsum(y[order])
                    k = np.arange(1, len(order))
                    cuts = (v[1:] > v[:-1]) & (k >= self.least) & (len(order) - k >= self.least)
                    if cuts.any():
                        left, right = hits[:-1], hits[-1] - hits[:-1]
                        impurity = np.where(cuts, left * (1 - left / k) + right * (1 - right / (len(order) - k)), np.inf)
                        j = int(impurity.argmin())
                        if impurity[j] < best[0]:
                            best = (float(impurity[j]), int(f), float((v[j] + v[j + 1]) / 2))
                if best[1] is None:
                    return at
                low = x[own, best[1]] <= best[2]
                nodes[at][:2] = best[1], best[2]
                nodes[at][2] = grow(own[low], depth + 1)
                nodes[at][3] = grow(own[~low], depth + 1)
                return at

            grow(rows, 0)
            self.grown.append(tuple(np.array(c) for c in zip(*nodes)))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.grown:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = feature[at] >= 0
                low = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(low, left[at], right[at]), at)
            total += share[at]
        return total / len(self.grown)


def candidates(text: str) -> list[tuple[int, str, str, str]]:
    """(start, value, name, up to BEFORE characters before) of each candidate."""
    out = []
    for m in CANDIDATE.finditer(text):
        part = next(p for p in ("block", "quoted", "value", "bare") if m[p] is not None)
        start = m.start(part)
        trimmed = m[part] if part in ("block", "quoted") else m[part].rstrip(".!%#$&*^~@")
        if len(trimmed) >= 8:
            out.append((start, trimmed, m["name"] or "", text[max(0, start - BEFORE) : start]))
    return out


def scan(docs: DataFrame, threshold: float = THRESHOLD, everything: bool = False, findings: list[tuple[str, str, str, int]] | None = None) -> DataFrame:
    """doc_id, start, length, name, value_sha256, score of each finding that the forest keeps; all candidates on request. `findings` are labelled ones to train on instead of the drawn ones."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = labelled_findings() if findings is None else (np.array([features(v, n, b) for v, n, b, _ in findings]), np.array([y for *_, y in findings]))
    forest = spark.sparkContext.broadcast(Forest().fit(*rows))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owners = [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                own = candidates(text or "")
                found += own
                owners += [doc] * len(own)
            if found:
                scores = forest.value.score(np.array([features(v, name, before) for _, v, name, before in found]))
                kept = [i for i in range(len(found)) if everything or scores[i] >= threshold]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([owners[i] for i in kept], batch.column("doc_id").type), pa.array([found[i][0] for i in kept], pa.int64()), pa.array([len(found[i][1]) for i in kept], pa.int64()),
                     pa.array([found[i][2] for i in kept], pa.string()), pa.array([hashlib.sha256(found[i][1].encode()).hexdigest() for i in kept], pa.string()), pa.array([float(scores[i]) for i in kept], pa.float64())],
                    ["doc_id", "start", "length", "name", "value_sha256", "score"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, start long, length long, name string, value_sha256 string, score double")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


ship(__name__)
