"""Secret scan: fixed patterns, and guess costs by dynamic programming for the values of credential contexts."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, table, trimmed

ASSIGN = re.compile(r"""(?P<key>(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Contexts beyond the fixed ones: a credential word, at most a copula or sign, then a value up to a blank or quote.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?i:password|passwd|passphrase|pass|pwd|secret|token|credential|auth|api[_-]?key|access[_-]?key|private[_-]?key)["']?(?:\x20+is|\x20*(?::=|=>|[:=]))\x20*["']?(?P<value>[^\s"'<>,;]{6,})""",
    re.ASCII,
)
#: Words that people build passwords from, most common first.
WORDS = (
    "password pass admin welcome login letmein qwerty dragon monkey master hello secret love star sun shadow football baseball "
    "summer winter spring autumn princess flower cookie freedom whatever trust batman superman michael jordan charlie george "
    "hunter ranger buster soccer hockey killer tiger pepper ginger summer ashley thomas robert daniel andrew test guest user root "
    "server system demo change default example sample temp access account company office money happy family friend orange purple "
    "blue green black white silver gold diamond coffee chocolate cheese banana apple house home school computer internet google "
    "the and for you are with this that have from not but all your value token key none null true false change me my is in on it"
).split()
#: Further words that stand for themselves after a credential word in prose, code or settings.
PROSE = (
    "required missing invalid incorrect expired wrong needed optional unknown undefined disabled enabled allowed denied rejected "
    "accepted rotated revoked refreshed generated encrypted encoded hashed hidden protected private public shared stored saved sent "
    "given provided supplied entered checked verified validated compared ignored omitted deleted removed replaced changed updated "
    "reset created issued signed expected specified configured passed returned received requested based bound limited never always "
    "something nothing different available unavailable your string integer number boolean object array character letters digits words "
    "phrase bearer basic digest session cookie header request response client service database config setting option parameter "
    "variable environment production development staging testing local remote placeholder redacted confidential secure sensitive "
    "compromised leaked exposed forgotten lost stolen horse battery staple correct username email authentication authorization"
).split()
#: Rows of a keyboard with the place of their first key, and the keys that shift turns into others.
ROWS = (("`1234567890-=", -1.0), ("qwertyuiop[]", 0.5), ("asdfghjkl;'", 0.75), ("zxcvbnm,./", 1.25))
UNSHIFT = str.maketrans("~!@#$%^&*()_+{}:\"<>?", "`1234567890-=[];',./")
LEET = str.maketrans("@4310$57!", "aaeiosstl")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/.](?:0?[1-9]|1[0-2])[-/.](?:19|20)?\d\d")
KEY_AT = {c: (r, first + k) for r, (row, first) in enumerate(ROWS) for k, c in enumerate(row)}
#: log10 of the guesses for a part's kind (of five), for a walk's first key, and for each further key of a walk.
KIND, FIRST_KEY, STEP = math.log10(5), math.log10(94), 0.35
#: A walk has so many keys at least, and a repeat copies so many characters at least.
WALK, REPEAT = 3, 3
#: After ` is `, letters in one case and no longer than an English word are prose if a letter costs less than WORDLIKE
#: (log10) on average given the one before; letters drawn at random cost more.
ENGLISH, WORDLIKE = 16, 1.4
#: A value is a secret if guessing it takes at least 10 to this power tries.
MIN_LOG10 = 9.0
#: Words learned from a corpus: letters only, of so many characters, in so many documents, and at most so many of them.
LEARNED, MIN_DOCS, MAX_WORDS = re.compile(r"[^\W\d_]{3,24}"), 3, 1 << 16
#: One of these stands in every credential context.
TRIGGERS = ("pass", "pwd", "secret", "token", "credential", "auth", "key")
#: Different words that a task counts before it passes them on.
FLUSH = 300_000


class Dictionary:
    """Words with their ranks, the likeliest first, and how likely letters follow each other in them."""

    def __init__(self, learned: Iterable[str] = ()):
        words = list(dict.fromkeys([*WORDS, *PROSE, *learned]))
        self.rank = {w: math.log10(k + 1) for k, w in enumerate(words)}
        self.longest = max(map(len, words))
        self.pairs = Counter(x + y for w in words for x, y in zip("^" + w, w + "$"))
        self.first = Counter(x for w in words for x in "^" + w)

    def wordlike(self, value: str) -> bool:
        """Whether letters in one case read like a word: the mean cost of each letter and the end by letter pairs."""
        low = value.lower()
        if not value.isalpha() or value not in (low, low.capitalize(), low.upper()) or len(value) > ENGLISH:
            return False
        costs = [math.log10((self.first[x] + 13) / (self.pairs[x + y] + 0.5)) for x, y in zip("^" + low, low + "$")]
        return sum(costs) / len(costs) < WORDLIKE

    def word_cost(self, text: str, low: str, plain: str) -> float | None:
        """log10 of the guesses for one word in its case and spelling; None if it is no word. low and plain are text in lower
        case and with its usual substitutions undone."""
        rank, extra = self.rank.get(low), 0.0
        if rank is None:
            rank, extra = self.rank.get(plain), 0.5
        if rank is None:
            return None
        return rank + extra + (0.0 if text == low else 0.3 if text.istitle() or text.isupper() else 0.3 * len(text))


DEFAULT = Dictionary()


def adjacent(a: str, b: str) -> bool:
    """Whether two keys lie beside or diagonally below each other, or two letters follow each other in the alphabet."""
    x, y = KEY_AT.get(a), KEY_AT.get(b)
    if a.isalpha() and b.isalpha() and abs(ord(a) - ord(b)) == 1:
        return True
    if x is None or y is None:
        return False
    return abs(x[1] - y[1]) == 1 if x[0] == y[0] else abs(x[0] - y[0]) == 1 and abs(x[1] - y[1]) < 1


def distances(value: str) -> list[int]:
    """For each place how far back the REPEAT characters from there were last seen before it; 0 where they were not."""
    last, out = {}, []
    for i in range(len(value)):
        piece = value[i : i + REPEAT]
        out.append(i - last[piece] if piece in last else 0)
        if len(piece) == REPEAT:
            last[piece] = i
    return out


def brute_cost(value: str) -> float:
    """log10 of the guesses for each character of a brute-force span: the size of the character classes of the value."""
    size = 10 * any(c.isdigit() for c in value) + 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 33 * any(not c.isalnum() for c in value)
    return math.log10(max(size, 10))


def date_cost(length: int) -> float:
    return math.log10(365 * 130) if length > 4 else math.log10(130)


def guess_cost(value: str, words: Dictionary = DEFAULT) -> float:
    """log10 of the guesses for the cheapest segmentation of the whole value; the guesses of the parts and of the
    kinds of all parts but the first are multiplied. A part is one of

    * a word, by its rank, case and spelling;
    * a date or year;
    * a repeat: REPEAT or more characters that say again what came u characters before, u being where the first REPEAT of
      them were last seen; it costs u times its length;
    * a keyboard walk of WALK keys or more, each beside the one before, or letters along the alphabet, in either direction;
    * a brute-force span.

    Every repeat and walk may end anywhere. best[i] is the least for the first i characters; walks and brute-force spans
    that are under way grow by a fixed cost for each character. A repeat under way grows by the logarithm of its length:
    of two at one distance the longer one grows less, so that once it is the cheaper it stays so, and the other is dropped.
    The time is proportional to the length of the value.
    """
    n, low = len(value), value.lower()
    if not n:
        return 0.0
    plain, keys = low.translate(LEET), low.translate(UNSHIFT)
    each, back = brute_cost(value), distances(value)
    best, brute, walk = [-KIND] + [math.inf] * n, math.inf, [math.inf] * (WALK + 1)
    copies: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        here = best[i] + KIND
        for j in range(i + 2, min(n, i + words.longest) + 1):
            cost = words.word_cost(value[i:j], low[i:j], plain[i:j])
            if cost is not None and here + cost < best[j]:
                best[j] = here + cost
        if value[i].isdigit() and (m := DATE.match(value, i)):
            for j in range(i + 4, m.end() + 1):
                if j == m.end() or DATE.fullmatch(value, i, j):
                    best[j] = min(best[j], here + date_cost(j - i))
        step = i > 0 and adjacent(keys[i - 1], keys[i])
        walk = [math.inf, here + FIRST_KEY, *[walk[k] + STEP if step else math.inf for k in range(1, WALK - 1)], min(walk[WALK - 1], walk[WALK]) + STEP if step else math.inf]
        brute = min(brute, here) + each
        if back[i]:
            copies.setdefault(back[i], []).append((i, here + math.log10(back[i])))
        least = min(best[i + 1], brute, walk[WALK])
        for u in [u for u in copies if value[i] != value[i - u]]:
            del copies[u]
        for u, starts in copies.items():
            kept, cheapest = [], math.inf
            for start, cost in starts:
                now = cost + math.log10(i + 1 - start)
                if now < cheapest:
                    cheapest = now
                    kept.append((start, cost))
                    if i + 1 - start >= REPEAT:
                        least = min(least, now)
            copies[u] = kept
        best[i + 1] = least
    return best[n]


def scan(text: str | None, min_log10: float = MIN_LOG10, words: Dictionary = DEFAULT) -> tuple[list, list]:
    """(base, added): lists of (kind, start, end, log10 of guesses or None); positions in code points."""
    text = text or ""
    raw = text.lower()
    base, added = [], []
    if any(w in raw for w in ("passw", "secret", "token", "apikey", "api_key")):
        for m in ASSIGN.finditer(text):
            if len(m["value"]) >= 12:
                base.append(("assign", m.start(), m.end(), guess_cost(m["value"], words)))
    if "AKIA" in text:
        base += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    if any(w in raw for w in TRIGGERS):
        taken = sorted((b[1], b[2]) for b in base)
        for m in CONTEXT.finditer(text):
            value = m["value"].rstrip(".)]}!?")
            start, end = m.start("value"), m.start("value") + len(value)
            prose = text[m.start() : start].rstrip("\"' ").lower().endswith(" is") and words.wordlike(value)
            if prose or any(s <= start and end <= e for s, e in taken):
                continue
            cost = guess_cost(value, words)
            if len(value) >= 6 and cost >= min_log10:
                added.append(("guess", start, end, cost))
    return base, added


ORDER = {"assign": 0, "access": 1, "hex": 2, "guess": 3}
FIELDS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, least_log10 double"


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e, _ in sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2])))


def _digest(min_log10: float, shared):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for d, t in zip(b.column(0), b.column(1)):
                base, added = scan(t.as_py(), min_log10, shared.value)
                n = [sum(x[0] == k for x in base) for k in ("assign", "access", "hex")]
                costs = [x[3] for x in base + added if x[3] is not None]
                rows.append((d.as_py(), *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + added), len(added), min(costs, default=None)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(8)], [f.split()[0] for f in FIELDS.split(", ")])

    return digest


def without_values(text: str) -> str:
    """text without the values in credential contexts: what stands there may be a secret however many documents hold it."""
    low = text.lower()
    if not any(w in low for w in TRIGGERS):
        return text
    for pattern in (ASSIGN, CONTEXT):
        text = pattern.sub(lambda m: m[0][: m.start("value") - m.start()], text)
    return text


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of the task that hold each word, values in credential contexts left out, passed on whenever the words
    are many."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    for b in batches:
        for t in b.column(0):
            counts.update(set(LEARNED.findall(without_values(t.as_py() or "").lower())))
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    if counts:
        yield out()


def learn_words(docs: DataFrame, text_col: str = "text", min_docs: int = MIN_DOCS, max_words: int = MAX_WORDS) -> Dictionary:
    """The words of docs by the number of documents that hold them, over all documents, those in fewer than min_docs left
    out, and never from a value in a credential context. Of equal counts all or none are taken, at most max_words,
    which bounds what reaches the driver and is broadcast."""
    counted = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(_count_words, "word string, n long")
    counts = save(counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs), "words")
    steps = counts.select(F.floor(32 * F.log2("n")).alias("step")).groupBy("step").count().orderBy(F.desc("step")).collect()
    total, least = 0, 1 << 20
    for step, n in steps:
        total += n
        if total > max_words:
            break
        least = step
    top = counts.where(F.floor(32 * F.log2("n")) >= least).collect()
    return Dictionary(r["word"] for r in sorted(top, key=lambda r: (-r["n"], r["word"])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_log10: float = MIN_LOG10, words: Dictionary | None = None) -> DataFrame:
    """One row per document with counts, digest and list of its spans: the fixed patterns, and values in a credential
    context whose guess cost reaches min_log10 and that no fixed span holds whole. After ` is `, letters in one case that
    read like one word are prose. The words are those of docs unless others are given.

    Null texts count as empty; ids may be null or repeat; other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words or learn_words(docs, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(_digest(min_log10, shared), FIELDS)


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "<secret>", min_log10: float = MIN_LOG10, words: Dictionary | None = None) -> DataFrame:
    """docs with every span found replaced by mark (of assignments the value only); all columns and null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(words or learn_words(docs, text_col))

    def clean(text: str | None) -> str | None:
        spans = [x[1:3] for part in scan(text, min_log10, shared.value) for x in part]
        if not spans:
            return text
        out, at = [], 0
        for start, end in sorted(spans):
            if m := ASSIGN.match(text, start):
                start = m.start("value") if m.end() == end else start
            if end > at:
                # A span that runs on from the one before shares its mark.
                out += [text[at:start], mark] if start >= at else []
                at = end
        return "".join(out) + text[at:]

    place = docs.columns.index(text_col)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([clean(t.as_py()) for t in b.column(place)], b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays([texts if k == place else b.column(k) for k in range(b.num_columns)], schema=b.schema)

    return docs.mapInArrow(trimmed(redact), docs.schema)


def op1_secret_guess_cost(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
