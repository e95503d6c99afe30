"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a whole run of characters as keys have them, of any length and make, taken out of the
text with the words around it. Its features are its length and classes of characters, how surprising its
character transitions are against ordinary words (a table of letter pairs), how much of it
dictionary words cover, its path (whether it is part of a path or URL, and the extension), and
what its neighbouring words say (words like token or password, words like checksum or commit).
Dictionary and transitions are learned from the whole words of a public tokenizer's vocabulary
(some 30,000; its file is a parameter), which goes to the executors with the forest.
A forest of randomised trees, trained from labelled findings, gives the share of trees that
call it a secret; findings at THRESHOLD or more are reported. Most candidates are plain words, so
Forest.most() is asked first, once for a run: a run whose own features keep its share under the
threshold in whatever context is not described again. That rejects nothing that share() accepts.

Labelled findings are a parameter: (context before, candidate, context after, label). By
default labelled_findings() writes them: issued keys of various make beside assignments, and
the usual false alarms, among them digests in checksum lists, commit ids, identifiers, paths,
placeholders and encoded media, and plain words and numbers behind words like password.

A null or empty text has no findings. Texts and candidates of any length are taken whole. A
secret that occurs twice is two findings, told apart by its place. Rows that are repeated each
give theirs. Extra columns, whatever their names, are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import hashlib
import json
import math
import operator
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import table

THRESHOLD = 0.5
TREES, DEPTH, LEAF = 40, 10, 2
TRAIN_FINDINGS = 3000
SEED = 23
#: Bytes of context on each side of a candidate.
AROUND = 48
#: Runs that are described at once, runs whose rejection is remembered, and the longest of these.
DESCRIBED, REMEMBERED, SHORT = 10_000, 300_000, 64

_CANDIDATE = re.compile(r"[A-Za-z0-9+/_\-.]+(?:={1,2}(?![A-Za-z0-9+/_\-]))?")
_WORD = re.compile(r"[A-Za-z]+")
_AGAIN = re.compile(r"(.)\1+")
#: The kind of each character of a candidate: digit, capital, other than a letter; small letters are the rest.
_KINDS = {**{ord(c): "d" for c in "0123456789"}, **{ord(c): "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{ord(c): "o" for c in "+/_-.="}, **{ord(c): "l" for c in "abcdefghijklmnopqrstuvwxyz"}}
# Words that stand beside secrets, words that stand beside what is none, and common words.
BESIDE = frozenset("token key secret password passwd pwd pass auth bearer credential credentials apikey api private access client signing login session".split())
NOT_BESIDE = frozenset("sha sha1 sha256 md5 digest checksum hash commit revision rev uuid guid id etag build version integrity example sample dummy placeholder test fingerprint serial object blob tree parent index phone tel isbn order".split())
COMMON = (
    "the and for that with this from have are was not but all can her his one our out you has had how man new now old see two way who its did get may him day use she than them then some time very when come here just like long make many more only over such take well were what your about other which their there first would these click value data user name file path test example image item page list code text string number config default service server client admin public static content index main module node class type error window document element style color width height script source target version update remove insert select create delete".split()
)
EXTENSIONS = frozenset("png jpg jpeg gif svg css js html htm json xml txt md py java c h cpp go rs rb php pdf zip gz tar mp3 mp4 woff ttf ico".split())


VOCABULARY = "word_bpe_49k.json"
#: Letters of dictionary words, least and most.
SHORTEST, LONGEST = 4, 12


class Words:
    """A dictionary, and the surprise in bits of each letter following another in its words."""

    def __init__(self, words: list[str]):
        self.listed = sorted(set(words))
        self.known = frozenset(w for w in self.listed if SHORTEST <= len(w) <= LONGEST)
        count = np.ones((27, 27))
        for word in self.listed:
            last = 26
            for ch in word:
                now = ord(ch) - 97
                count[last, now] += 1
                last = now
            count[last, 26] += 1
        pairs = -np.log2(count / count.sum(1, keepdims=True))
        #: By two characters: the surprise of the second, if it is a letter.
        every, small = "0123456789+/_-.= abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyz"
        self.steps = {a + c: float(pairs[small.find(a), small.index(c)]) if c in small else 0.0 for a in every for c in every}
        self.heads = frozenset(w[:SHORTEST] for w in self.known)

    def covered(self, low: str) -> int:
        """Letters of a lower-cased string that dictionary words cover, the longest first."""
        out = 0
        for run in _WORD.finditer(low):
            part = run.group()
            i, n = 0, len(part)
            while i + SHORTEST <= n:
                if part[i : i + SHORTEST] not in self.heads:
                    i += 1
                    continue
                for k in range(min(LONGEST, n - i), SHORTEST - 1, -1):
                    if part[i : i + k] in self.known:
                        out += k
                        i += k - 1
                        break
                i += 1
        return out


_words: dict[str | None, Words] = {}


def words_of(path: str | None = None) -> Words:
    """The whole words of a vocabulary file (by default a public tokenizer's), read once in a process."""
    if path not in _words:
        place = path
        if place is None:
            import public_tokenizers

            place = public_tokenizers.path(VOCABULARY)
        with open(place, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        whole = (w.removesuffix("</w>") for w in vocabulary if w.endswith("</w>"))
        _words[path] = Words([w for w in whole if len(w) > 1 and re.fullmatch("[a-z]+", w)])
    return _words[path]


NAMES = ("length", "upper", "lower", "digit", "hex", "entropy", "classes", "transitions", "turns", "dictionary", "slashes", "dots", "dashes", "extension", "url", "assigned", "quoted", "beside", "not_beside", "repeats", "padding", "run")
#: Features that a candidate's context can change.
OF_CONTEXT = frozenset(NAMES.index(n) for n in ("url", "assigned", "quoted", "beside", "not_beside"))


def describe(before: str, key: str, after: str, words: Words | None = None) -> list[float]:
    """The features of a candidate, as NAMES."""
    words = words or words_of()
    n = len(key)
    low = key.lower()
    kinds = key.translate(_KINDS)
    upper, digit, other = kinds.count("U"), kinds.count("d"), kinds.count("o")
    lower = n - upper - digit - other
    letters = upper + lower
    share = [key.count(c) / n for c in set(key)]
    turns = sum(map(operator.ne, "l" + kinds.replace("o", "l"), kinds.replace("o", "l")))
    surprise = sum(map(words.steps.__getitem__, map(operator.add, " " + low, low))) / letters if letters else 8.0
    near: set[str] = set()
    if before:
        said = _WORD.findall(before[-AROUND:])
        near = set([w.lower() for w in said][-4:])
        near |= {p for w in said[-4:] for p in re.findall(r"[a-z]+", re.sub(r"([A-Z])", r" \1", w).lower())}
    tail = before.rstrip()[-2:]
    run = max((m.end() - m.start() for m in _AGAIN.finditer(key)), default=1)
    return [
        n, upper / n, lower / n, digit / n, (digit + sum(map(low.count, "abcdef"))) / n, -sum(p * math.log2(p) for p in share),
        (upper > 0) + (lower > 0) + (digit > 0) + (other > 0), surprise, turns / n, words.covered(low) / n,
        key.count("/"), key.count("."), key.count("-") + key.count("_"), float(low.rpartition(".")[2] in EXTENSIONS), float("://" in before[-AROUND:].rpartition(" ")[2] or low.startswith("www.") or "//" in key),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(tail[-1:] in ("\"", "'") and after[:1] in ("\"", "'")), float(len(near & BESIDE)), float(len(near & NOT_BESIDE)),
        n / max(1, len(set(key))), float(key.endswith("=")), run,
    ]


class Forest:
    """Randomised trees as flat arrays: feature (-1: leaf), bar, left, right, value; and the words that features are made with."""

    def __init__(self, trees: list[np.ndarray], words: Words):
        self.trees, self.words = trees, words

    def describe(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        return np.array([describe(*f, self.words) for f in found])

    def share(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = t[at, 0].astype(np.int64)
                live = np.flatnonzero(f >= 0)
                if not len(live):
                    break
                rows = t[at[live]]
                at[live] = np.where(x[live, f[live]] <= rows[:, 1], rows[:, 2], rows[:, 3]).astype(np.int64)
            out += t[at, 4]
        return out / max(1, len(self.trees))

    def most(self, x: np.ndarray) -> np.ndarray:
        """The greatest share that rows may have in any context (each tree's best one, so never too low)."""

        def best(t: np.ndarray, node: int, rows: np.ndarray) -> np.ndarray:
            f, bar, left, right, value = t[node]
            if f < 0 or not len(rows):
                return np.full(len(rows), value)
            if int(f) in OF_CONTEXT:
                return np.maximum(best(t, int(left), rows), best(t, int(right), rows))
            low = x[rows, int(f)] <= bar
            out = np.empty(len(rows))
            out[low], out[~low] = best(t, int(left), rows[low]), best(t, int(right), rows[~low])
            return out

        out = np.zeros(len(x))
        for t in self.trees:
            out += best(t, 0, np.arange(len(x)))
        return out / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    nodes: list[list[float]] = []

    def impurity(a: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = a / np.maximum(n, 1)
        return n * p * (1 - p)

    def build(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        mine = y[rows]
        nodes.append([-1, 0, 0, 0, mine.mean()])
        if depth == DEPTH or len(rows) < 2 * LEAF or mine.min() == mine.max():
            return me
        best = (np.inf, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[rows, f], kind="stable")
            v, ones = x[rows[order], f], np.cumsum(mine[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= LEAF) & (cut <= len(rows) - LEAF)]
            if not len(cut):
                continue
            cost = impurity(ones[cut - 1], cut) + impurity(ones[-1] - ones[cut - 1], len(rows) - cut)
            k = int(np.argmin(cost))
            if cost[k] < best[0]:
                best = (cost[k], int(f), (v[cut[k] - 1] + v[cut[k]]) / 2)
        if best[1] < 0:
            return me
        left = x[rows, best[1]] <= best[2]
        nodes[me][:4] = [best[1], best[2], build(rows[left], depth + 1), build(rows[~left], depth + 1)]
        return me

    build(rng.integers(0, len(x), len(x)), 0)
    return np.array(nodes)


def train(findings: list[tuple[str, str, str, int]], trees: int = TREES, seed: int = SEED, words: Words | None = None) -> Forest:
    words = words or words_of()
    rng = np.random.default_rng(seed)
    x = np.array([describe(*f[:3], words) for f in findings])
    y = np.array([f[3] for f in findings], float)
    return Forest([_grow(x, y, rng) for _ in range(trees)], words)


def labelled_findings(many: int = TRAIN_FINDINGS, seed: int = SEED, words: Words | None = None) -> list[tuple[str, str, str, int]]:
    """Candidates with their contexts: half of them secrets, half false alarms."""
    rng = random.Random(seed)
    listed = (words or words_of()).listed
    hexa, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    draw = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    word = lambda: rng.choice(COMMON) if (r := rng.random()) < 0.3 else rng.choice(listed) if r < 0.8 else draw("abcdefghilmnoprstuvwy", 2, 9)
    prose = lambda: " ".join(word() for _ in range(rng.randint(1, 8)))
    digitise = lambda s: s if any(c.isdigit() for c in s) else s + draw("0123456789", 1, 2)
    out = []
    for i in range(many):
        q = rng.choice(['"', "'", '"', ""])
        if i % 2:
            name = rng.choice(["token", "key", "secret", "password", "api_key", "apiKey", "auth_token", "accessToken", "client_secret", "PASSWORD", "SECRET_KEY", "private_key", "Authorization: Bearer", "passwd"])
            key = rng.choice([
                lambda: draw(hexa, 32, 64), lambda: draw(hexa, 40, 40), lambda: draw(alnum, 20, 64), lambda: draw(alnum + "+/", 40, 88) + rng.choice(["", "=", "=="]),
                lambda: "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 16), lambda: "ghp_" + draw(alnum, 36, 36), lambda: "sk-" + draw(alnum, 32, 48), lambda: "xoxb-" + draw("0123456789", 10, 12) + "-" + draw(alnum, 20, 24),
                lambda: "eyJ" + draw(alnum, 18, 40) + "." + "eyJ" + draw(alnum, 20, 60) + "." + draw(alnum + "_-", 30, 43),
                lambda: "eyJ" + draw(alnum, 18, 400) + "." + "eyJ" + draw(alnum, 200, 2000) + "." + draw(alnum + "_-", 30, 700), lambda: draw(alnum + "+/", 400, 3000) + rng.choice(["", "=", "=="]),
                lambda: draw(alnum, 10, 20), lambda: draw(hexa, 16, 32), lambda: draw(alnum[:52], 20, 48),
            ])()
            link = rng.choice([" = ", "=", ": ", " := ", " "]) if "Bearer" not in name else " "
            before = f"{prose()} {name}{link}{q}" if rng.random() < 0.93 or key[:3] not in ("AKI", "ghp", "sk-", "xox") else f"{prose()} {q}"
            out.append((before, key if len(key) < 20 or rng.random() < 0.2 else digitise(key), f"{q} {prose()}", 1))
        else:
            kind = rng.randrange(14)
            name = ""
            if kind == 0:
                name, key = rng.choice(["sha256", "md5", "checksum", "digest", "integrity", "etag", "hash"]) + rng.choice([": ", "=", " = ", " "]), draw(hexa, 32, 64)
            elif kind == 1:
                name, key = rng.choice(["commit ", "revision ", "rev: ", "parent ", "tree ", "blob "]), draw(hexa, 40, 40)
            elif kind == 2:
                name, key = rng.choice(["uuid: ", "id=", "guid = ", "request id ", ""]), "-".join(draw(hexa, k, k) for k in (8, 4, 4, 4, 12))
            elif kind == 3:
                name, key = rng.choice(["", "see ", "path: ", "file="]), "/".join(word() for _ in range(rng.randint(2, 5))) + draw("0123456789", 1, 3) + rng.choice([".png", ".js", ".html", "", "/" + word()])
            elif kind == 4:
                name, key = rng.choice(["", "import ", "call ", "name = ", "class="]), rng.choice(["_", "-", "."]).join(word() for _ in range(rng.randint(3, 6))) + draw("0123456789", 1, 3)
            elif kind == 5:
                name, key = rng.choice(["token=", "key: ", "password = ", "secret="]), rng.choice(["your_api_key_here_0", "example_token_123456", "xxxxxxxxxxxxxxxxxxxx0", "00000000000000000000", "changeme_password_1", "test_test_test_test_1", "placeholder_value_01", "INSERT_YOUR_KEY_HERE_0", "1234567890123456", "abcdefghijklmnop0123"])
            elif kind == 6:
                name, key = rng.choice(["", "phone ", "order ", "card ", "serial "]), draw("0123456789", 16, 24)
            elif kind == 7:
                name, key = "https://" + word() + ".com/", word() + "/" + draw(alnum, 8, 24) + "/" + draw("0123456789", 1, 6)
            elif kind == 8:
                name, key = "", word() + draw("0123456789", 1, 4) + "".join(word().title() for _ in range(rng.randint(2, 4)))
            elif kind == 9:
                name, key = rng.choice(["data:image/png;base64,", "src=data:font/woff;base64,", "", "image: ", "content="]), draw(alnum + "+/", 200, 3000) + rng.choice(["", "=", "=="])
            elif kind == 10:
                name, key = "", rng.choice("-_./x0") * rng.randint(1, 80)
            else:
                name = rng.choice(["token", "key", "secret", "password", "api_key", "private key", "", "", "", "name", "id", "?page", "date"]) + rng.choice([" = ", "=", ": ", " ", " "])
                made = word() if kind < 13 else rng.choice(["_", "-", ".", "/", ""]).join(rng.choice([word(), word().title()]) for _ in range(rng.randint(2, 8)))
                key = rng.choice([made, made, made.title(), made.upper(), made + rng.choice(".-/"), rng.choice(["", "v", "-"]) + draw("0123456789", 1, 8), made + draw("0123456789", 1, 3), rng.choice("-./").join(draw("0123456789", 1, 4) for _ in range(rng.randint(2, 4)))])
            if kind < 9:
                key = digitise(key)
            out.append((f"{prose()} {name}{q}", key, f"{q} {prose()}", 0))
    return out


_forests: dict[int, Forest] = {}


def default_forest() -> Forest:
    if SEED not in _forests:
        _forests[SEED] = train(labelled_findings())
    return _forests[SEED]


def candidates(text: str) -> list[tuple[int, str]]:
    """Place and key of every candidate of a text."""
    return [(m.start(), m.group()) for m in _CANDIDATE.finditer(text)]


def findings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, at (place in characters), size, score, key_sha256 of every reported secret."""
    sent = docs.sparkSession.sparkContext.broadcast(forest or default_forest())  # some thousand numbers, and the vocabulary's words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        refused: set[str] = set()

        def judge(held: list[tuple[int | None, str, int, str]]) -> pa.RecordBatch | None:
            fresh = list({key for _, _, _, key in held})
            most = trees.most(trees.describe([("", key, "") for key in fresh]))
            out = {key for key, m in zip(fresh, most) if m < threshold}
            if len(refused) > REMEMBERED:
                refused.clear()
            refused.update(key for key in out if len(key) <= SHORT)
            held = [h for h in held if h[3] not in out]
            if not held:
                return None
            score = trees.share(trees.describe([(whole[max(0, at - AROUND) : at], key, whole[at + len(key) : at + len(key) + AROUND]) for _, whole, at, key in held]))
            made = pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.int64()), pa.array([len(h[3]) for h in held], pa.int64()), pa.array(score), pa.array([hashlib.sha256(h[3].encode()).hexdigest() for h in held], pa.string())],
                ["doc_id", "at", "size", "score", "key_sha256"],
            )
            return made.filter(pa.array(score >= threshold))

        for batch in batches:
            held = []
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                whole = value.as_py() or ""
                for at, key in candidates(whole):
                    if key not in refused:
                        held.append((i, whole, at, key))
                        if len(held) == DESCRIBED:
                            made = judge(held)
                            held = []
                            if made is not None:
                                yield made
            if held:
                made = judge(held)
                if made is not None:
                    yield made

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, at long, size long, score double, key_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(table(spark, sf_dir, "documents"))
