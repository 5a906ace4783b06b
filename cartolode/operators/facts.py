"""Facts of source files and the graph over them: extraction, complexity, callee scoping, the semantic graph, renames."""

from __future__ import annotations

import ast
import math
from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolode.functions.scalar import bare_name, name_similarity
from cartolode.operators.lexed import GRAMMARS, lexed_facts
from cartolode.operators.scripts import script_facts
from cartolode.sources.tables import save

FACTS = "path string, kind string, name string, line int, end_line int, cc int, callees array<string>, parse_ok boolean"
#: Callees too common to be joined across a repository.
COMMON_CALLEES = (
    "add build check close compare create delete exec execute filter find get handle handler init load main map open parse read reduce "
    "remove resolve run save set start stop update validate write"
).split()
#: Keys of a JSON payload below which paths stand.
TOUCH_KEYS = "file files filePath path paths relativePath relativePaths from to definitions importers reachable changed added removed modified".split()
#: Endings of the files that count as paths without a folder.
TOUCH_ENDINGS = "ts tsx js jsx mjs cjs mts cts py go java rb rs php cs json yaml yml toml md".split()
#: Files that a task takes at a time.
TASK_FILES = 2000
#: How each language writes an import, the module being the first group.
IMPORTS = {
    "javascript": r"""(?m)^\s*(?:import\s+(?:[\w*{}\s,$]+\s+from\s+)?|export\s+[\w*{}\s,$]+\s+from\s+)['"]([^'"]+)['"]""",
    "python": r"(?m)^\s*(?:from|import)\s+([\w.]+)",
    "go": r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([\w./-]+)"\s*$""",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "rust": r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)",
    "php": r"(?m)^\s*use\s+([\w\\]+)",
    "ruby": r"""(?m)^\s*require(?:_relative)?\s*\(?['"]([^'"]+)['"]""",
    "csharp": r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",
    "kotlin": r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)",
    "swift": r"(?m)^\s*(?:@\w+\s+)*import\s+(?:(?:struct|class|enum|protocol|func|typealias|let|var)\s+)?([\w.]+)",
    "cpp": r'''(?m)^\s*#\s*include\s*[<"]([^>"\n]+)[>"]''',
}
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)


def extract_imports(files: DataFrame, language: str) -> DataFrame:
    """Distinct (path, spec) of the import lines of files(path, content)."""
    return files.select("path", F.explode(F.regexp_extract_all("content", F.lit(IMPORTS[language]), 1)).alias("spec")).where("spec <> ''").distinct()


def cyclomatic(content: Column) -> Column:
    """Decision points plus one of a text in a C-like language, once strings and comments are taken out: an approximation."""
    bare = F.regexp_replace(content, r"""(?s)/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", " ")
    return F.regexp_count(bare, F.lit(r"\b(?:if|for|while|case|catch)\b|&&|\|\||\?(?![.?:])")) + 1


def _decisions(node: ast.AST) -> int:
    each = lambda n: len(n.values) - 1 if isinstance(n, ast.BoolOp) else len(n.ifs) + 1 if isinstance(n, ast.comprehension) else int(isinstance(n, _BRANCHES))
    return 1 + sum(each(n) for n in ast.walk(node))


def _called(node: ast.AST) -> list[str]:
    calls = (n.func for n in ast.walk(node) if isinstance(n, ast.Call))
    return sorted({f.attr if isinstance(f, ast.Attribute) else f.id for f in calls if isinstance(f, ast.Attribute | ast.Name)})


def python_facts(path: str, content: str) -> list[tuple]:
    """Rows of FACTS of one file: the file itself, its functions, classes' names put before their methods', and its exports, which
    are the names in __all__ or else those defined at the top that do not begin with an underscore."""
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [(path, "file", path, 1, None, None, [], False)]
    rows = [(path, "file", path, 1, (content or "").count("\n") + 1, _decisions(tree), _called(tree), True)]
    todo = [(tree, "")]
    while todo:
        node, prefix = todo.pop()
        for child in ast.iter_child_nodes(node):
            inner = prefix
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                inner = f"{prefix}{child.name}."
                if not isinstance(child, ast.ClassDef):
                    rows.append((path, "function", prefix + child.name, child.lineno, child.end_lineno, _decisions(child), _called(child), True))
            todo.append((child, inner))
    return rows + [(path, "export", name, None, None, None, [], True) for name in _exported(tree)]


def _exported(tree: ast.Module) -> list[str]:
    names: set[str] = set()
    for node in tree.body:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target] if isinstance(node, ast.AnnAssign) else []
        assigned = {t.id for t in targets if isinstance(t, ast.Name)}
        if "__all__" in assigned and isinstance(node.value, ast.List | ast.Tuple):
            return sorted({e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)})
        names |= assigned | ({node.name} if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef) else set())
    return sorted(n for n in names if not n.startswith("_"))


#: Extractors by language; each takes a path and a text and gives rows of FACTS.
LANGUAGES: dict[str, tuple[tuple, Callable]] = {
    "python": ((".py",), python_facts),
    "javascript": ((".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts"), script_facts),
    **{name: (g.extensions, partial(lexed_facts, name)) for name, g in GRAMMARS.items()},
}


def register_language(name: str, extensions: tuple, extract: Callable[[str, str], list[tuple]]) -> None:
    LANGUAGES[name] = (extensions, extract)


def extract_facts(files: DataFrame, *languages: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Facts of files(path, content) of the languages' extensions, all registered ones by default, in one pass: a row a file,
    a function and an export. A file that does not parse, for which the extractor fails, or that is larger than the bound has
    one row with parse_ok false."""
    by_extension = {e: LANGUAGES[name][1] for name in languages or LANGUAGES for e in LANGUAGES[name][0]}
    mine = reduce(lambda a, e: a | F.col("path").endswith(e), by_extension, F.lit(False))
    extract = lambda path, content: by_extension[max((e for e in by_extension if path.endswith(e)), key=len)](path, content)
    columns = [c.split()[0] for c in FACTS.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += extract(path, content)
                except Exception:  # noqa: BLE001 - an extractor is the user's; its failure is a fact about the file
                    rows.append((path, "file", path, 1, None, None, [], False))
            out = pd.DataFrame(rows, columns=columns)
            for c in ("line", "end_line", "cc"):
                out[c] = out[c].astype("Int32")
            yield out

    # Small tables may stand in one part of one file, which would be one task.
    parts = max(-(-files.count() // TASK_FILES), int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    known = files.where(mine).select("path", "content").repartition(parts, "path").withColumn("big", F.coalesce(F.octet_length("content"), F.lit(0)) > most_bytes)
    large = known.where("big").selectExpr("path", "'file' as kind", "path as name", "1 as line", "cast(null as int) as end_line", "cast(null as int) as cc", "cast(array() as array<string>) as callees", "false as parse_ok")
    return known.where("not big").select("path", "content").mapInPandas(parse, FACTS).unionByName(large)


#: Analyzers that users add: name to (category, function of files to issues).
ANALYZERS: dict[str, tuple[str, Callable[[DataFrame], DataFrame]]] = {}


def register_analyzer(name: str, analyze: Callable[[DataFrame], DataFrame], category: str = "plugin") -> None:
    ANALYZERS[name] = (category, analyze)


def run_analyzers(files: DataFrame) -> tuple[DataFrame, list[str]]:
    """Issues (rule_id, severity, category, path) of all registered analyzers, rules named `plugin:name:rule`, and the names
    of those that failed, lack a column or raised while they ran: each one's rows are written once, so that a failure ends that
    analyzer and not the job. Rows without a rule or with an unknown severity are dropped."""
    out = files.sparkSession.createDataFrame([], "rule_id string, severity string, category string, path string")
    failed = []
    for name, (category, analyze) in ANALYZERS.items():
        try:
            rows = analyze(files)
            rows = rows if "category" in rows.columns else rows.withColumn("category", F.lit(None).cast("string"))
            rows = rows.select("rule_id", "severity", "category", "path").where("rule_id is not null and severity in ('error', 'warning', 'info')")
            rows = save(rows, "plugin")
        except Exception:  # noqa: BLE001 - a failing analyzer is skipped and named
            failed.append(name)
            continue
        out = out.unionByName(rows.select(F.concat(F.lit(f"plugin:{name}:"), "rule_id").alias("rule_id"), "severity", F.coalesce("category", F.lit(category)).alias("category"), "path"))
    return out, failed


#: Rows of one side of pairs that stand in one row until they are told, and of each side in a tile.
BLOCK, SIDE = 256, 4096


def every_pair(left: DataFrame, right: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(keys, a, b) of each row of left(keys, a) and right(keys, b) that share the keys. The pairs are not shuffled.

    A task tells tiles of a few thousand rows by a few thousand, and of a tile each row of right with a block of left before the next:
    so many pairs are made of so few values, which repeat soon, that a column writer needs about a bit a value.
    """
    count = lambda df, n: df.groupBy(*keys).agg(F.count("*").alias(n))
    sizes = save(count(left, "n").join(count(right, "m"), keys), "sizes")
    pairs = sizes.agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0
    parts = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(pairs / SIDE**2))
    tiles = lambda n: F.ceil(F.col(n) / SIDE)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), tiles(n) - 1))
    block = F.pmod(F.xxhash64(a, F.lit(1)), F.ceil(F.col("n") / BLOCK))
    blocks = left.join(sizes, keys).withColumn("block", block).groupBy(*keys, "m", "block").agg(F.collect_list(a).alias("many"))
    blocks = blocks.select(*keys, F.floor(F.col("block") / (SIDE // BLOCK)).alias("at"), every("m").alias("to"), "many")
    rows = right.join(sizes, keys).select(*keys, every("n").alias("at"), F.pmod(F.xxhash64(b, F.lit(2)), tiles("m")).alias("to"), b)
    blocks, rows = (x.repartition(parts, *keys, "at", "to") for x in (blocks, rows))
    return blocks.join(rows.hint("merge"), [*keys, "at", "to"]).select(*keys, F.explode("many").alias(a), b)


def resolve_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """calls(caller, file, callee), functions(fn, file, bare) and imports(src, dst) to (caller, fn): functions of that name in
    the same file, else in files imported, else the only one anywhere if the name is not a common one."""
    calls = save(calls.select("caller", "file", "callee").distinct(), "calls")
    asked = calls.select("file", "callee").distinct()
    named = functions.select("fn", F.col("file").alias("at"), F.col("bare").alias("callee"))
    here = asked.join(named.withColumnRenamed("at", "file"), ["file", "callee"]).select("file", "callee", "fn")
    rest = asked.join(here.select("file", "callee").distinct(), ["file", "callee"], "left_anti")
    near = rest.join(imports.select(F.col("src").alias("file"), F.col("dst").alias("at")).distinct(), "file").join(named, ["at", "callee"]).select("file", "callee", "fn")
    far = rest.join(near.select("file", "callee").distinct(), ["file", "callee"], "left_anti").where(~F.col("callee").isin(*COMMON_CALLEES) & (F.length("callee") > 2))
    only = named.groupBy("callee").agg(F.count("*").alias("n"), F.min("fn").alias("fn")).where("n = 1").select("callee", "fn")
    found = save(here.unionByName(near).unionByName(far.join(only, "callee").select("file", "callee", "fn")).distinct(), "resolved")
    pairs = every_pair(calls, found, ["file", "callee"], "caller", "fn").select("caller", "fn")
    # A pair can come twice only from a function of two names or a caller of two files; else the pairs, which are many, stay where they form.
    twice = lambda df, key, value: df.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low <> high")
    once = twice(found, "fn", "callee").isEmpty() and twice(calls, "caller", "file").isEmpty()
    return pairs if once else pairs.distinct()


def semantic_nodes(files: DataFrame, functions: DataFrame, packages: DataFrame, symbols: DataFrame) -> DataFrame:
    """Nodes (id, kind, label) of files(path), functions(path, name, line), packages(path, name) and symbols(path, name)."""
    node = lambda df, kind, label, ident: df.select(ident.alias("id"), F.lit(kind).alias("kind"), F.col(label).alias("label"))
    parts = [
        node(files, "file", "path", F.concat(F.lit("file:"), "path")),
        node(functions, "function", "name", function_id()),
        node(packages, "package", "name", F.concat(F.lit("package:"), "name")),
        node(symbols, "symbol", "name", F.concat(F.lit("symbol:"), "name")),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def function_id() -> Column:
    return F.concat(F.lit("function:"), "path", F.lit("#"), "name", F.lit("@"), F.col("line").cast("string"))


def semantic_edges(functions: DataFrame, packages: DataFrame, symbols: DataFrame, imports: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges (start, end, kind, label): files define functions, import packages and files(src, dst) and export symbols;
    functions call those with the bare name of calls(path, name, line, callee)."""
    at = lambda kind, name: F.concat(F.lit(kind + ":"), F.col(name))
    edge = lambda df, start, end, kind, label: df.select(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), F.col(label).alias("label"))
    # Each part is made distinct before its join and its texts, so that the many calls of a common name are never shuffled.
    known = save(functions.select(function_id().alias("target"), bare_name(F.col("name")).alias("callee")).distinct(), "known")
    calls = save(calls.select(function_id().alias("caller"), "callee").distinct(), "calls")
    called = every_pair(calls, known, ["callee"], "caller", "target").where("caller <> target")
    parts = [
        edge(functions, at("file", "path"), function_id(), "defines", "name").distinct(),
        edge(packages, at("file", "path"), at("package", "name"), "imports_package", "name").distinct(),
        edge(imports, at("file", "src"), at("file", "dst"), "imports", "dst").distinct(),
        edge(symbols, at("file", "path"), at("symbol", "name"), "exports", "name").distinct(),
        edge(called, F.col("caller"), F.col("target"), "calls", "callee"),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Nodes and edges of a graph that a report shows, and the kinds of nodes and edges in the order in which they come.
MOST_NODES, MOST_EDGES = 2000, 5000
KINDS = "file function package symbol defines imports_package imports exports calls".split()


def limited_graph(nodes: DataFrame, edges: DataFrame, most_nodes: int = MOST_NODES, most_edges: int = MOST_EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first nodes by kind and id, the first edges between them by kind, start, end and label, and one row of metrics: files,
    functions, packages, symbols (of all nodes), edges (shown) and whether anything was left out."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, KINDS)), c)
    kept = save(nodes.orderBy(rank(F.col("kind")), "id").limit(most_nodes), "nodes")
    ends = F.broadcast(kept.select("id"))
    inside = edges.join(ends.withColumnRenamed("id", "start"), "start", "left_semi").join(ends.withColumnRenamed("id", "end"), "end", "left_semi")
    shown = save(inside.select(edges.columns).orderBy(rank(F.col("kind")), "start", "end", "label").limit(most_edges), "edges")
    totals = nodes.agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in KINDS[:4]], F.count("*").alias("all_nodes"))
    # One edge more than a report shows tells that some are left out; the others need no counting.
    some = edges.limit(most_edges + 1).agg(F.count("*").alias("all_edges"))
    counted = totals.crossJoin(some).crossJoin(shown.agg(F.count("*").alias("edges")))
    cut = (F.col("all_nodes") > most_nodes) | (F.col("all_edges") > F.col("edges"))
    return kept, shown, counted.select("files", "functions", "packages", "symbols", "edges", cut.alias("truncated"))


#: Scores down to which pairs of names are matched one after another, the old names of a group that a task holds, the tasks that
#: compare them, a fixed number since names are small and their pairs are not, and the names of one length that are compared at once.
LEVELS, PIECE, COMPARING, TILE = (0.85, 0.8, 0.75, 0.7, 0.6), 4096, 200, 256
#: Characters of a name are counted in so many classes, up to so many each, a bit for each one.
CLASSES, COUNTED = 42, 3


def _letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of names, and 128 bits of each of which an edit changes two at most, an insertion or deletion one."""
    sizes = np.fromiter(map(len, names), np.int64, len(names))
    codes = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    at = np.repeat(np.arange(len(names)), sizes) * CLASSES + codes % CLASSES
    counts = np.bincount(at, minlength=len(names) * CLASSES).reshape(-1, CLASSES, 1)
    bits = np.zeros((len(names), 128), bool)
    bits[:, : CLASSES * COUNTED] = (counts > np.arange(COUNTED)).reshape(-1, CLASSES * COUNTED)
    return sizes, np.packbits(bits, axis=1).view(np.uint64)


def _by_length(names: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of names of each length, so many at a time: the length, their places and their bits."""
    sizes, bits = _letters(names)
    order = np.argsort(sizes, kind="stable")
    parts = []
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        parts += [(int(sizes[part[0]]), part[k : k + TILE], bits[part[k : k + TILE]]) for k in range(0, len(part), TILE)]
    return parts


def _similar_names(level: float):
    """Of rows (by, piece, side, name) in order of the first three, the pairs (by, old, new) of a name of side 0 and one of side 1 whose
    characters allow the score: never without a pair that has it. The old names of a piece are held, the new ones stream by."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, olds, held = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                by, piece, side = keys[low]
                names = batch.column(3).slice(low, high - low).to_pylist()
                if (by, piece) != group:
                    group, olds, held = (by, piece), [], None
                if not side:
                    olds += names
                    continue
                if not olds:
                    continue
                held = held or _by_length(olds)
                sides = pa.array(olds, pa.string()), pa.array(names, pa.string())
                for n, mine, own in _by_length(names):
                    for m, at, bits in held:
                        most = math.floor((1 - level) * max(m, n) + 1e-9)
                        if abs(m - n) > most:
                            continue
                        apart = np.bitwise_count(bits[:, None, 0] ^ own[None, :, 0])
                        i, j = np.nonzero(apart <= 2 * most - abs(m - n))
                        ok = apart[i, j] + np.bitwise_count(bits[i, 1] ^ own[j, 1]) <= 2 * most - abs(m - n)
                        i, j = i[ok], j[ok]
                        if len(i):
                            found = [batch.column(0).take(pa.array(np.full(len(i), low))), sides[0].take(pa.array(at[i])), sides[1].take(pa.array(mine[j]))]
                            yield pa.RecordBatch.from_arrays(found, ["by", "old", "new"])

    return pairs


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (by, old, new) in order of their group and rank, those of which neither name was taken by one before."""
    group, olds, news = None, set(), set()
    for batch in batches:
        keep = []
        for k, (at, old, new) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            if at != group:
                group, olds, news = at, set(), set()
            if old not in olds and new not in news:
                olds.add(old)
                news.add(new)
                keep.append(k)
        yield batch.take(pa.array(keep, pa.int64()))


def match_renames(removed: DataFrame, added: DataFrame, least: float = 0.5, by: str = "path") -> DataFrame:
    """Pairs (by, old, new) of removed(by, name) and added(by, name) alike enough, each name once, the likest first and ties by name.

    Level by level, pairs down to a score are formed of the names that are left, and taken one by one in order, which lower pairs
    cannot change. No name's share of affix exceeds its edit similarity, so a bounded edit distance tells which pairs can reach
    the level, and counts of characters which of them it has to be taken of. Every two names of a group meet as these counts only, in
    tiles. Pairs stream through tasks; the names taken of a group have to fit in one.
    """
    olds = save(removed.select(by, F.col("name").alias("old")).where(F.col(by).isNotNull() & F.col("old").isNotNull()).distinct(), "old")
    news = save(added.select(by, F.col("name").alias("new")).where(F.col(by).isNotNull() & F.col("new").isNotNull()).distinct(), "new")
    kind = olds.schema[by].dataType.simpleString()
    found = []
    for level in [x for x in LEVELS if x > least] + [least]:
        groups = olds.groupBy(by).agg(F.ceil(F.count("*") / PIECE).alias("pieces"))
        pieces = olds.join(groups, by).select(by, F.pmod(F.xxhash64("old"), "pieces").alias("piece"), F.lit(0).alias("side"), F.col("old").alias("name"))
        every = news.join(groups, by).select(by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), F.lit(1).alias("side"), F.col("new").alias("name"))
        dealt = pieces.unionByName(every).repartition(COMPARING, by, "piece").sortWithinPartitions(by, "piece", "side")
        most = f"cast(floor({1 - level}D * greatest(length(old), length(new)) + 1e-9) as int)"
        near = F.expr(f"abs(length(old) - length(new)) <= {most} and levenshtein(old, new, {most}) >= 0")
        pairs = dealt.mapInArrow(_similar_names(level), f"by {kind}, old string, new string").withColumnRenamed("by", by).where(near)
        ranked = save(pairs.withColumn("score", name_similarity(F.col("old"), F.col("new"))).where(F.col("score") >= level), "pairs")
        ranked = ranked.repartition(by).sortWithinPartitions(by, F.desc("score"), "old", "new").select(by, "old", "new")
        found.append(save(ranked.mapInArrow(_taken, ranked.schema), "renames"))
        olds = save(olds.join(found[-1].select(by, "old"), [by, "old"], "left_anti"), "old")
        news = save(news.join(found[-1].select(by, "new"), [by, "new"], "left_anti"), "new")
        if olds.isEmpty() or news.isEmpty():
            break
    return reduce(DataFrame.unionByName, found)


def like_path(p: Column) -> Column:
    """Whether a text looks like a path of a file: relative, no address, no step upwards, no control characters, at most 1,024
    characters, and with a source file's ending, or a folder and nothing but plain characters."""
    plain = ~p.startswith("/") & ~p.rlike(r"^(?:https?|file)://|[\n\r\t]") & ~p.rlike(r"(?:^|/)\.\.(?:/|$)") & F.length(p).between(1, 1024)
    return plain & (F.lower(p).rlike(r"\.(?:" + "|".join(TOUCH_ENDINGS) + ")$") | (p.contains("/") & p.rlike("^[A-Za-z0-9._/@-]+$")))


def payload_paths(events: DataFrame, key: str, text: str, depth: int = 8, most: int = 200) -> DataFrame:
    """Distinct (key, path) of the strings below TOUCH_KEYS in JSON texts that look like paths, so many levels deep at most; what a
    list holds stands below the list's key. Of one payload the first paths count, its objects in order of their keys.

    Payloads are parsed once; each round looks one level deeper, at objects and lists only, and is a written table. Texts that
    are no JSON have none.
    """
    payloads = events.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.try_parse_json(text).alias("v")).where("v is not null")
    level = save(payloads.select("row", key, "v", F.lit(None).cast("string").alias("hint"), F.array().cast("array<int>").alias("at")), "payloads")
    found = []
    for _ in range(depth):
        inner = level.alias("l").lateralJoin(events.sparkSession.tvf.variant_explode(F.col("l.v").outer()).alias("e"))
        level = save(inner.select("l.row", F.col(f"l.{key}"), F.col("e.value").alias("v"), F.coalesce("e.key", "l.hint").alias("hint"), F.concat("l.at", F.array("e.pos")).alias("at")), "payloads")
        kind = F.schema_of_variant("v")
        text_of = F.try_variant_get("v", "$", "string")
        found.append(level.where((kind == "STRING") & F.col("hint").isin(*TOUCH_KEYS)).select("row", key, text_of.alias("path"), "at").where(like_path(F.col("path"))))
        level = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY"))
        if level.isEmpty():
            break
    once = reduce(DataFrame.unionByName, found).groupBy("row", key, "path").agg(F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy("at", "path"))
    return once.withColumn("n", rank).where(F.col("n") <= most).select(key, "path").distinct()
