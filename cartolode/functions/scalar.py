"""Column functions: rounding, path classes, buckets, token estimates, version drift, names, redaction, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round_half_up(x: Column, places: int = 0) -> Column:
    """Halves go towards plus infinity."""
    k = 10.0**places
    return F.floor(x * k + 0.5) / F.lit(k)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ancestors(path: Column) -> Column:
    """The path and every directory above it: `a/b/c` gives [a/b/c, a/b, a]."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def classify_path(path: Column) -> Column:
    """The first class that a path belongs to."""
    name = F.substring_index(path, "/", -1)
    return (
        F.when((path == "README.md") | path.rlike(r"^docs/|\.mdx?$"), "docs")
        .when(path.rlike("^(coverage|dist)/"), "generated")
        .when(path.rlike(r"^\.env($|\.)|/auth|/security|/secrets|\.(pem|key)$"), "security")
        .when(name.rlike(r"^(package|tsconfig)\.json$|\.(toml|ya?ml|ini|cfg)$") | path.startswith(".github/"), "config")
        .when(path.rlike(r"^tests?/|/__tests__/|\.(test|spec)\.[cm]?[jt]sx?$"), "test")
        .when(path.rlike("^(src|app|lib|packages|apps)/"), "production")
        .otherwise("other")
    )


def bucket_duration(ms: Column) -> Column:
    return F.when(ms.isNull() | F.isnan(ms.cast("double")) | (ms < 1000), "<1s").when(ms < 5000, "1-5s").when(ms < 30_000, "5-30s").when(ms < 120_000, "30s-2m").otherwise("2m+")


def bucket_count(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n == 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 100, "21-100").otherwise("100+")


def bucket_minutes(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n <= 5, "1-5").when(n <= 10, "6-10").when(n <= 20, "10-20").otherwise("20+")


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def bare_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def semver_drift(declared: Column, installed: Column) -> Column:
    """major, minor, patch, same, or unknown where either is no version."""
    part = lambda v, k: F.regexp_extract(v, r"^[\^~>=v ]*(\d+)\.(\d+)\.(\d+)", k)
    known = (part(declared, 1) != "") & (part(installed, 1) != "")
    differ = [part(declared, k) != part(installed, k) for k in (1, 2, 3)]
    return F.when(~known, "unknown").when(differ[0], "major").when(differ[1], "minor").when(differ[2], "patch").otherwise("same")


def name_similarity(a: Column, b: Column) -> Column:
    """The larger of edit similarity and the share of the longer name that the longer of common prefix and suffix makes up."""
    longest, shortest = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    shared = lambda x, y: F.aggregate(
        F.sequence(F.lit(1), F.greatest(shortest, F.lit(1))),
        F.lit(0),
        lambda n, k: F.when((n == k - 1) & (k <= shortest) & (F.substring(x, k, F.lit(1)) == F.substring(y, k, F.lit(1))), k).otherwise(n),
    )
    affix = F.greatest(shared(a, b), shared(F.reverse(a), F.reverse(b)))
    return F.when(longest == 0, 1.0).otherwise(F.greatest(1 - F.levenshtein(a, b) / longest, affix / longest))


#: Fixed values, applied in this order: what a text must not show, and the mark that takes its place; a key stays.
REDACTIONS = (
    (r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[redacted]"),
    (r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", "[redacted]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "[redacted]"),
    (r"(?i)\bBearer\s+[A-Za-z0-9._~+/=-]+", "[redacted]"),
    (r"(?i)\b(?:sk|pk|whsec|ghp|gho|github_pat)[_-][A-Za-z0-9_=-]{8,}", "[redacted]"),
    (r"(?i)\b([A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|PASSWD|PWD|API[_-]?KEY|ACCESS[_-]?KEY|PRIVATE[_-]?KEY)[A-Z0-9_]*)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\"'\s,;]+)", "$1=[redacted]"),
    (r"(?i)\b(password|passwd|pwd|token|secret|api[_-]?key)\s*[:=]\s*(?:\"[^\"]*\"|'[^']*'|[^\"'\s,;]+)", "$1=[redacted]"),
    (r"(?i)(--?(?:password|passwd|pwd|token|secret|api[_-]?key))\s+(?:\"[^\"]*\"|'[^']*'|[^\"'\s,;]+)", "$1=[redacted]"),
    (r"(?i)\b[A-Za-z_][A-Za-z0-9_]*\.env\s*[:=]\s*(?:\"[^\"]*\"|'[^']*'|[^\"'\s,;]+)", "[redacted]"),
)


def redact_secrets(text: Column) -> Column:
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


#: Words that no index holds, of English, of TypeScript and of Python.
STOP_WORDS = "the a an and or not of to in is it for on with this that by as at be are was were has have had".split()
SCRIPT_WORDS = (
    "const let var function return if else while for do break continue switch case default new class extends implements interface type enum "
    "public private protected static readonly async await try catch finally throw import export from as typeof instanceof void null undefined "
    "true false this super yield delete in of any never unknown string number boolean object symbol bigint"
).split()
PYTHON_WORDS = (
    "def class self cls lambda yield pass elif none true false and or not is in import from as with try except finally raise assert global "
    "nonlocal del async await return if else for while break continue"
).split()


def identifier_parts(text: Column) -> Column:
    """Lower-case parts of identifiers: split at non-identifier characters, underscores, case and digits."""
    joined = F.regexp_replace(text, "[^A-Za-z0-9]+", " ")
    for pattern, to in ((r"([a-z0-9])([A-Z])", "$1 $2"), (r"([A-Z]+)([A-Z][a-z])", "$1 $2"), (r"([0-9]+)", " $1 ")):
        joined = F.regexp_replace(joined, pattern, to)
    return F.split(F.trim(F.lower(joined)), " +")


def stemmed(part: Column) -> Column:
    """part without one ending: `ing` of what is longer than three characters, `ed` and `es` than four, else a single `s` than
    three."""
    n, cut = F.length(part), lambda k: F.substring(part, F.lit(1), F.length(part) - k)
    plain = part.endswith("s") & ~part.endswith("ss")
    return F.when(part.endswith("ing") & (n > 3), cut(3)).when((part.endswith("ed") | part.endswith("es")) & (n > 4), cut(2)).when(plain & (n > 3), cut(1)).otherwise(part)


def indexed(term: Column) -> Column:
    """Whether an index holds the term."""
    return (F.length(term) >= 2) & ~term.isin(sorted({*STOP_WORDS, *SCRIPT_WORDS, *PYTHON_WORDS}))


def tokenize(text: Column) -> Column:
    """The stemmed parts of identifiers that an index holds, as an array; terms() gives them as rows, which runs faster."""
    return F.filter(F.transform(identifier_parts(text), stemmed), indexed)


def terms(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """(keep, term): a row for each term of the text that an index holds."""
    parts = df.select(*keep, F.explode(identifier_parts(F.col(text))).alias("part"))
    return parts.select(*keep, stemmed(F.col("part")).alias("term")).where(indexed(F.col("term")))
