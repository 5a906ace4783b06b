"""Where user input enters functions and where it acts: tags by calls, reads, receivers, frameworks' handlers and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that bring in what users send, those of them that count as calls only, and those that are too common as
#: plain reads and count only by a framework's rule.
SOURCES = "env argv body query params headers cookies readFile readFileSync stdin getInput".split()
CALLED_SOURCES = "getInput readFile readFileSync stdin".split()
COMMON_SOURCES = "body query params headers cookies".split()
#: Calls that act on what they are given.
SINKS = "exec execSync spawn spawnSync eval Function writeFile writeFileSync unlink rmSync rm query execute system os.system subprocess innerHTML".split()
#: Sinks that count in scripts only if they come from the process module, and the module's names.
SHELL, SHELL_MODULES = "exec execSync spawn spawnSync".split(), ("node:child_process", "child_process")
#: Sinks that count in scripts only on a database; names of such receivers, modules and packages.
DATABASE = "query execute $queryRaw $executeRaw raw".split()
RECEIVERS = "db database pool client connection conn prisma knex sequelize repository repo manager sql".split()
DATABASE_MODULES = "db database sql pool client repository repo".split()
DATABASE_PACKAGES = "pg postgres mysql mysql2 sqlite3 better-sqlite3 knex sequelize @prisma/client".split()
SCRIPT = r"\.(?:cjs|mjs|js|jsx|ts|tsx)$"
VERBS, METHODS = "DELETE GET HEAD OPTIONS PATCH POST PUT".split(), "all delete get head options patch post put".split()
#: How a handler of each framework is known: by the package its file imports and the method it is handed to, or
#: by the pattern of its path and its name. In order of precedence.
FRAMEWORKS = {
    "next.headers": {},
    "next.cookies": {},
    "next": {"path": r"(?:^|/)(?:app|src/app)/.*/route\.(?:cjs|mjs|js|jsx|ts|tsx)$", "names": VERBS},
    "remix": {"path": r"(?:^|/)app/routes/.+\.(?:cjs|mjs|js|jsx|ts|tsx)$", "names": "action loader clientAction clientLoader".split()},
    "sveltekit": {"path": r"(?:^|/)(?:src/)?routes/(?:.*/)?\+server\.(?:cjs|mjs|js|ts)$", "names": VERBS},
    "sveltekit.load": {"path": r"(?:^|/)(?:src/)?routes/(?:.*/)?\+(?:layout|page)\.server\.(?:cjs|mjs|js|ts)$", "names": ["load"]},
    "sveltekit.hook": {"path": r"(?:^|/)(?:src/)?hooks\.server\.(?:cjs|mjs|js|ts)$", "names": ["handle"]},
    "astro": {"path": r"(?:^|/)(?:src/)?pages/.*\.(?:cjs|mjs|js|ts)$", "names": VERBS},
    "hono": {"package": r"^hono(?:/|$)", "methods": [*METHODS, "use"]},
    "express": {"package": r"^express$", "methods": [*METHODS, "use"]},
    "fastify": {"package": r"^fastify(?:/|$)", "methods": [*METHODS, "route"]},
    "koa": {"package": r"^(?:koa|@koa/router|koa-router)$", "methods": [*METHODS, "use"]},
}
READERS = "json=json formData=formData text=text arrayBuffer=arrayBuffer headers.get=headers"
KIT = [
    ("call", "request", "", READERS, "sveltekit.request."), ("call", "event requestEvent", "request.", READERS, "sveltekit.request."),
    ("member", "request", "", "url headers", "sveltekit.request."), ("member", "event requestEvent", "request.", "url headers", "sveltekit.request."),
    ("member", "params", "", "*=params", "sveltekit."), ("member", "event requestEvent", "params.", "*=params", "sveltekit."),
    ("call", "url", "", "searchParams.get=searchParams", "sveltekit.url."), ("call", "event requestEvent", "url.", "searchParams.get=searchParams", "sveltekit.url."),
    ("member", "url", "", "searchParams pathname", "sveltekit.url."), ("member", "event requestEvent", "url.", "searchParams pathname", "sveltekit.url."),
    ("call", "cookies", "", "get getAll", "sveltekit.cookies."), ("call", "event requestEvent", "cookies.", "get getAll", "sveltekit.cookies."),
]
#: What counts as input in a handler, in order: how it is used (a call on a parameter, a read of one, a read of
#: any receiver, a plain call), names of the parameter (none: any), what stands between, members (member=source where they
#: differ, * for any), and how the source's name begins. Two neighbours of the same use and source are one step of the search.
RULES = {
    "next.headers": [("direct", "", "", "headers", "next.")],
    "next.cookies": [("direct", "", "", "cookies", "next.")],
    "next": [
        ("call", "", "", READERS + " cookies.get=cookies cookies.getAll=cookies", "request."),
        ("member", "", "", "url headers cookies nextUrl.pathname nextUrl.searchParams", "request."),
    ],
    "remix": [("call", "request", "", READERS, "remix.request."), ("member", "request", "", "url headers signal", "remix.request."), ("member", "params", "", "*=params", "remix.")],
    "sveltekit": KIT,
    "sveltekit.load": KIT,
    "sveltekit.hook": KIT,
    "astro": [
        ("call", "request", "", READERS, "astro.request."), ("call", "context apiContext", "request.", READERS, "astro.request."),
        ("member", "request", "", "url headers method", "astro.request."), ("member", "context apiContext", "request.", "url headers method", "astro.request."),
        ("member", "params", "", "*=params", "astro."), ("member", "context apiContext", "params.", "*=params", "astro."),
    ],
    "hono": [
        ("call", "c ctx context", "req.", "json parseBody text arrayBuffer blob formData query queries param header raw.headers.get=raw.headers valid", "hono.req."),
        ("member", "c ctx context", "req.", "url path raw.url raw.headers", "hono.req."),
    ],
    "express": [
        ("member", "req request", "", "originalUrl url path", "express.req."), ("reference", "req request", "", "body query params headers cookies ip", "express.req."),
        ("call", "req request", "", "get header param", "express.req."),
    ],
    "fastify": [
        ("member", "req request", "", "raw.headers raw.url host hostname url originalUrl", "fastify.request."),
        ("reference", "req request", "", "body query params headers cookies ip", "fastify.request."),
    ],
    "koa": [
        ("member", "ctx context", "", "request.body request.query request.headers request.ip request.url request.originalUrl request.path query params headers ip url originalUrl path", "koa.ctx."),
        ("call", "ctx context", "", "get request.get cookies.get", "koa.ctx."),
    ],
}
ARRAYS = ("callees", "references", "direct_calls", "member_calls", "member_aliases", "member_references", "parameters")


def rule_rows() -> list[tuple]:
    """RULES as rows (framework, form, names, tail, source, rank): rank orders frameworks and steps, place the members of one."""
    rows = []
    for f, (framework, steps) in enumerate(RULES.items()):
        step, before = -1, None
        for form, names, between, members, prefix in steps:
            step += (form, prefix, members) != before
            before = (form, prefix, members)
            for place, member in enumerate(members.split()):
                tail, _, source = member.partition("=")
                rows.append((framework, form, names.split() or None, between + tail, prefix + (source or tail), 100 * f + step, bool(between), place))
    return rows


def _last(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def _on_database(member: Column, callee: Column) -> Column:
    """Whether a call like `pool.query` is one of callee on a database."""
    parts = F.split(member, r"\.")
    return (F.element_at(parts, -1) == callee) & (F.size(parts) > 1) & F.lower(F.try_element_at(parts, F.lit(-2))).isin(*RECEIVERS)


def tag_sinks(functions: DataFrame, imports: DataFrame, sinks: tuple = ()) -> DataFrame:
    """(fn, sink): the first callee that is a sink. In scripts, a shell sink has to come from an import of the process module and
    a database sink from a call on a database, an alias of one, or an import from a database's module; a user's sinks need not."""
    called = functions.select("fn", "path", "member_calls", "member_aliases", "direct_calls", F.posexplode("callees").alias("at", "callee")).where(F.col("callee").isin(*SINKS, *sinks))
    c = F.col("callee")
    alias = lambda x: (F.substring_index(x, "=", 1) == c) & x.contains("=") & _on_database(F.get(F.split(x, "="), F.lit(1)), c)
    plain = F.array_contains("direct_calls", c)
    known = F.exists("member_calls", lambda m: _on_database(m, c)) | (plain & F.exists("member_aliases", alias))
    free = ~F.col("path").rlike(SCRIPT) | c.isin(*sinks) | ~c.isin(*SHELL, *DATABASE) | (c.isin(*DATABASE) & known)
    asked = called.select("fn", "path", "at", "callee", free.alias("free"), plain.alias("plain"))
    names = F.coalesce("names", F.array().cast("array<string>"))
    module = F.lower(F.regexp_replace(F.element_at(F.split(F.translate("spec", "\\", "/"), "/"), -1), r"(?i)\.(?:c|m)?(?:j|t)sx?$", ""))
    shell = imports.where(F.col("spec").isin(*SHELL_MODULES)).select("path", F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(*map(F.lit, SHELL)))).alias("callee"))
    database = imports.where(F.col("spec").isin(*DATABASE_PACKAGES) | module.isin(*DATABASE_MODULES)).select("path", F.explode(names).alias("callee"))
    held = asked.where("not free").drop("free", "plain")
    cleared = held.where(c.isin(*SHELL)).join(shell.distinct(), ["path", "callee"], "left_semi")
    cleared = cleared.unionByName(asked.where("not free and plain").drop("free", "plain").where(c.isin(*DATABASE)).join(database.distinct(), ["path", "callee"], "left_semi"))
    return asked.where("free").drop("free", "plain").unionByName(cleared).groupBy("fn").agg(F.min_by("callee", "at").alias("sink"))


def tag_requests(functions: DataFrame, imports: DataFrame) -> DataFrame:
    """(fn, request): the first input that a framework's handler reads from its request, by RULES."""
    spec = F.col("spec")
    found = [F.when(spec.rlike(rule["package"]), F.lit(name)) for name, rule in FRAMEWORKS.items() if "package" in rule]
    static = (spec == "next/headers") & ~F.coalesce("type_only", F.lit(False)) & (F.coalesce("kind", F.lit("static")) == "static")
    found += [F.when(static & F.array_contains("names", name), F.lit(f"next.{name}")) for name in ("headers", "cookies")]
    of_file = imports.select("path", F.explode(F.array_compact(F.array(*found))).alias("framework")).groupBy("path").agg(F.collect_set("framework").alias("imported"))
    bare, method, place = _last(F.col("name")), _last(F.col("context_call")), F.translate("path", "\\", "/")
    gates = []
    for name, rule in FRAMEWORKS.items():
        gate = F.array_contains("imported", name) if "path" not in rule else place.rlike(rule["path"]) & bare.isin(*rule["names"])
        gates.append(F.when(gate & method.isin(*rule["methods"]) if "methods" in rule else gate, F.lit(name)))
    opened = functions.join(of_file, "path", "left").withColumn("frameworks", F.array_compact(F.array(*gates))).where("size(frameworks) > 0")
    text = lambda form, column: F.transform(column, lambda x: F.struct(F.lit(form).alias("form"), x.alias("text")))
    each = F.concat(*(text(*x) for x in (("call", "member_calls"), ("member", "member_references"), ("reference", "references"), ("direct", "direct_calls"))))
    used = opened.select("fn", "frameworks", "parameters", F.explode(each).alias("use")).select("fn", "frameworks", "parameters", "use.form", "use.text")
    dotted = F.col("form").isin("call", "member")
    parameter, rest = F.substring_index("text", ".", 1), F.expr("substring(text, instr(text, '.') + 1)")
    tails = F.when(~dotted, F.array("text")).when(~F.contains("text", F.lit(".")), F.array().cast("array<string>")).otherwise(
        F.array_compact(F.array(rest, F.lit("*"), F.when(rest.startswith("params."), F.lit("params.*")))))
    used = used.select("fn", "frameworks", "parameters", "form", F.when(dotted, parameter).alias("parameter"), F.explode(tails).alias("tail"))
    rules = functions.sparkSession.createDataFrame(rule_rows(), "framework string, form string, names array<string>, tail string, source string, rank int, through boolean, place int")
    met = used.join(F.broadcast(rules), ["form", "tail"]).where(F.array_contains("frameworks", F.col("framework")))
    at = F.array_position("parameters", F.coalesce("parameter", F.lit("")))
    named = F.when(F.col("parameter").isNotNull(), (at > 0) & (F.col("names").isNull() | F.array_contains("names", F.col("parameter"))))
    fits = F.coalesce(named, F.col("names").isNull() | F.arrays_overlap("names", "parameters"))
    return met.where(fits).groupBy("fn").agg(F.min_by("source", F.struct("rank", "through", at.alias("at"), "place")).alias("request"))


def tag_endpoints(functions: DataFrame, imports: DataFrame, sources: tuple = (), sinks: tuple = ()) -> DataFrame:
    """(fn, source, sink) of functions(fn, path, name, context_call, and the arrays of ARRAYS, of which any may be missing or
    null), with imports(path, spec, names, kind, type_only): the input that each reads and the acting call that it makes, null
    for none.

    The source is a framework's request where there is one, else the first read that is a source but not a common name, else
    the first call that is a user's source or one that counts as a call. The whole environment handed on to a child process,
    none of its variables read, is no source. Users' sources and sinks join the fixed ones. A null fn has no tags.
    """
    empty = F.array().cast("array<string>")
    arrays = [(F.coalesce(c, empty) if c in functions.columns else empty).alias(c) for c in ARRAYS]
    texts = [F.col(c) if c in functions.columns else F.lit(None).cast("string").alias(c) for c in ("path", "name", "context_call")]
    rows = functions.select("fn", *texts, *arrays)
    more = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "string"), ("type_only", "boolean")) if c not in imports.columns]
    imports = imports.select("*", *more)
    every = {*SOURCES, *(r[4] for r in rule_rows()), *sources} - (set(COMMON_SOURCES) - set(sources))
    first = lambda column, names: F.get(F.filter(column, lambda x: x.isin(*sorted(names))), F.lit(0))
    plain = F.coalesce(first("references", every), first("callees", {*CALLED_SOURCES, *sources}))
    tagged = rows.select("fn", "member_references", plain.alias("plain")).join(tag_requests(rows, imports), "fn", "left").join(tag_sinks(rows, imports, sinks), "fn", "left")
    source, reads = F.coalesce("request", "plain"), F.col("member_references")
    whole = F.array_contains(reads, "process.env") & ~F.exists(reads, lambda x: x.startswith("process.env."))
    passed = (source == "env") & F.col("sink").isin(*(set(SHELL) - set(sinks))) & whole & F.lit("env" not in sources)
    return tagged.select("fn", F.when(~F.coalesce(passed, F.lit(False)), source).alias("source"), "sink")
