"""Small fixtures, and plain versions of the operators that tests hold results against."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    """Documents 0, 1, ... of the texts; a (doc_id, text) pair gives its own id."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        source = sources[i] if sources else f"src{i % 3}"
        rows.append((doc_id, text, "en", source, len(text or "")))
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def clashing(docs):
    """The documents with further columns named like those that operators use inside."""
    extra = {c: F.lit("x") for c in ("h", "key", "kept", "row", "doc", "host", "id", "base", "n", "piece", "uid", "ids", "best")}
    return docs.withColumns(extra)


def prose(n, seed=1, words=60, vocabulary=400):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(vocabulary)}x{rng.randrange(9)}" for _ in range(rng.randint(1, words))) for _ in range(n)]


def twins(size=10):
    """Two words that every polynomial hash modulo a power of two takes for one."""
    word = "a"
    for _ in range(size):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def nasty():
    """Null, empty, blank, repeated, long, colliding, and text outside ASCII."""
    one, other = twins()
    return [
        None, "", " \t\n\x0b", "a", "a", "A a\nA a\nA a", "é ß 日本 🙂 x", "\x1c\x85 odd   spaces  ",
        "one two three four five six seven eight nine ten eleven", "x" * 3000, "word " * 3000, "tok<|endoftext|>en",
        one, other, f"{one}\n{other}", f"a {one} b\u00a0 c", f"a {other} b\u00a0 c",
    ]


def measures(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(runs)
    covered = {j for i, r in enumerate(runs) if count[r] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), repeated, len(covered)


def near_groups(docs, size, percent):
    """doc_id -> (size of its set, smallest id reachable); docs is a dict."""
    sets = {}
    for k, t in docs.items():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    holders = defaultdict(list)
    for k, s in sets.items():
        for gram in s:
            holders[gram].append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        for j, common in Counter(j for g in s for j in holders[g] if j < k).items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = find(k), find(j)
                parent[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}


def _digits(text):
    return re.sub("[^0-9]", "", text)


def _luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 16 <= len(_digits(h)) <= 19 and _luhn(_digits(h))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 8 <= len(_digits(h)) <= 15),
)
SECRETS = (
    (
        "assign",
        r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        lambda m: len(m.group(2)) >= 8,
    ),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
)


def personal(text):
    """Spans per kind."""
    return [
        [f"{name}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if keep(m.group())]
        for name, p, keep in PERSONAL
    ]


def secrets(text):
    found = [
        (m.start(), i, f"{name}:{m.start()}:{m.end()}")
        for i, (name, p, keep) in enumerate(SECRETS)
        for m in re.finditer(p, text or "")
        if keep(m)
    ]
    return [s for _, _, s in sorted(found)]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()
