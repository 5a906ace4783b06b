"""Tags of sources and sinks on literal functions."""

import pytest

from cartolode.operators.endpoints import rule_rows, tag_endpoints

FUNCTIONS = (
    "fn string, path string, name string, context_call string, callees array<string>, references array<string>, direct_calls array<string>, "
    "member_calls array<string>, member_aliases array<string>, member_references array<string>, parameters array<string>"
)
IMPORTS = "path string, spec string, names array<string>, kind string, type_only boolean"


def fn(path="src/a.ts", name="f", context=None, callees="", references="", direct="", members="", aliases="", reads="", parameters=""):
    return (path, name, context, *(x.split() for x in (callees, references, direct, members, aliases, reads, parameters)))


EXPRESS = [("express", ["express"])]
CASES = {
    # a child process fed from a variable; all of the environment handed on; imports decide on shell calls
    "env to exec": (fn(callees="exec", references="env CMD", reads="process.env process.env.CMD"), [("child_process", ["exec"])], "env", "exec"),
    "env passed on": (fn(callees="spawn", references="env", reads="process.env"), [("node:child_process", ["spawn"])], None, "spawn"),
    "whole module": (fn(callees="spawn"), [("child_process", [])], None, "spawn"),
    "pattern exec": (fn(callees="exec", members="RE.exec", references="argv"), [], "argv", None),
    "other name imported": (fn(callees="exec"), [("child_process", ["spawn"])], None, None),
    "python exec": (fn(path="a.py", callees="exec system"), [], None, "exec"),
    # databases
    "receiver": (fn(callees="query", members="this.db.query"), [], None, "query"),
    "receiver in capitals": (fn(callees="query", members="Pool.query"), [], None, "query"),
    "cache is none": (fn(callees="query", members="cache.query", references="env"), [("pg", ["Pool"])], "env", None),
    "imported helper": (fn(callees="query", direct="query"), [("./lib/DB.mjs", ["query"])], None, "query"),
    "helper of a package": (fn(callees="query", direct="query"), [("pg", ["query"])], None, "query"),
    "helper called on something": (fn(callees="query", members="x.query"), [("./db", ["query"])], None, None),
    "alias": (fn(callees="query", direct="query", aliases="query=pool.query"), [], None, "query"),
    "alias of another": (fn(callees="query", direct="query", aliases="query=cache.query"), [], None, None),
    "raw is no sink by default": (fn(callees="raw", members="knex.raw"), [], None, None),
    "second callee": (fn(callees="exec eval"), [], None, "eval"),
    # plain reads and calls
    "common read": (fn(references="body headers x"), [], None, None),
    "argv read": (fn(references="body argv"), [], "argv", None),
    "called source": (fn(callees="getInput readFile"), [], "getInput", None),
    "read before call": (fn(callees="getInput", references="stdin"), [], "stdin", None),
    "env called": (fn(callees="env"), [], None, None),
    # frameworks
    "express body": (fn(context="app.post", callees="query json", references="body sql", members="db.query res.json", reads="req.body.sql req.body", parameters="req res"), EXPRESS, "express.req.body", "query"),
    "express member first": (fn(context="app.get", references="body url", reads="request.url", parameters="request"), EXPRESS, "express.req.url", None),
    "express call": (fn(context="router.use", members="req.header", parameters="req"), EXPRESS, "express.req.header", None),
    "express parameter missing": (fn(context="app.post", references="body", parameters="x y"), EXPRESS, None, None),
    "express not a handler": (fn(references="body", parameters="req"), EXPRESS, None, None),
    "express not imported": (fn(context="app.post", references="body", parameters="req"), [], None, None),
    "fastify": (fn(context="server.route", references="body", reads="req.raw.url", parameters="req"), [("fastify", [])], "fastify.request.raw.url", None),
    "koa": (fn(context="router.get", members="ctx.get", reads="ctx.request.body ctx.query", parameters="ctx"), [("@koa/router", [])], "koa.ctx.request.body", None),
    "koa call": (fn(context="router.get", members="ctx.cookies.get", parameters="ctx"), [("koa", [])], "koa.ctx.cookies.get", None),
    "hono": (fn(context="app.get", members="c.req.raw.headers.get c.req.query", reads="c.req.url", parameters="c"), [("hono/tiny", [])], "hono.req.query", None),
    "next route": (fn("src/app/api/x/route.ts", "POST", members="req.cookies.get req.json", reads="req.url", parameters="req"), [], "request.json", None),
    "next second parameter": (fn("app/x/route.js", "GET", reads="b.headers a.nextUrl.pathname", parameters="a b"), [], "request.nextUrl.pathname", None),
    "next elsewhere": (fn("lib/route.ts", "POST", members="req.json", parameters="req"), [], None, None),
    "next headers": (fn("lib/x.ts", direct="cookies"), [("next/headers", ["cookies"])], "next.cookies", None),
    "next headers type": (fn("lib/x.ts", direct="cookies"), [("next/headers", ["cookies"], "static", True)], None, None),
    "next headers lazy": (fn("lib/x.ts", direct="cookies"), [("next/headers", ["cookies"], "dynamic", False)], None, None),
    "remix params": (fn("app/routes/a.tsx", "loader", reads="params.id", parameters="params"), [], "remix.params", None),
    "remix reader": (fn("app/routes/a.tsx", "action", members="request.formData", reads="params.id request.url", parameters="request params"), [], "remix.request.formData", None),
    "svelte event": (fn("src/routes/x/+server.ts", "POST", members="event.request.json event.cookies.get", parameters="event"), [], "sveltekit.request.json", None),
    "svelte params": (fn("routes/+page.server.js", "load", reads="event.params.slug", members="event.cookies.get", parameters="event"), [], "sveltekit.params", None),
    "svelte direct first": (fn("routes/+server.js", "GET", members="event.url.searchParams.get url.searchParams.get", parameters="event url"), [], "sveltekit.url.searchParams", None),
    "svelte hook": (fn("src/hooks.server.ts", "handle", members="event.cookies.getAll", parameters="event"), [], "sveltekit.cookies.getAll", None),
    "astro": (fn("src/pages/api/x.ts", "GET", reads="context.request.method context.params.id", parameters="context"), [], "astro.request.method", None),
    "astro params": (fn("src/pages/api/x.ts", "M.GET", reads="params.id", parameters="params"), [], "astro.params", None),
}


@pytest.fixture(scope="module")
def tables(spark):
    rows, imports = [], []
    for k, (name, (f, imported, *_)) in enumerate(CASES.items()):
        path = f"r{k}/{f[0]}"
        rows.append((name, path, *f[1:]))
        imports += [(path, *i, *("static", False)[len(i) - 2 :]) for i in imported]
    return spark.createDataFrame(rows, FUNCTIONS), spark.createDataFrame(imports, IMPORTS)


def test_cases(tables):
    got = {r["fn"]: (r["source"], r["sink"]) for r in tag_endpoints(*tables).collect()}
    assert got == {name: tuple(c[2:]) for name, c in CASES.items()}


def test_users_names(tables):
    got = {r["fn"]: (r["source"], r["sink"]) for r in tag_endpoints(*tables, sources=("body", "own", "env"), sinks=("raw", "exec")).collect()}
    assert got["common read"] == ("body", None) and got["raw is no sink by default"] == (None, "raw") and got["pattern exec"] == ("argv", "exec")
    assert got["env passed on"] == ("env", "spawn") and got["env called"] == ("env", None)


def test_missing_and_null_columns(spark):
    functions = spark.createDataFrame([("a", ["eval"], None), ("b", None, ["argv"]), (None, ["eval"], None)], "fn string, callees array<string>, references array<string>")
    imports = spark.createDataFrame([], "path string, spec string, names array<string>")
    got = sorted(tag_endpoints(functions, imports).collect(), key=str)
    assert [tuple(r) for r in got if r["fn"]] == [("a", None, "eval"), ("b", "argv", None)]
    assert tag_endpoints(functions.limit(0), imports).count() == 0


def test_rules_are_a_small_table():
    assert 100 < len(rule_rows()) < 200 and len({r[5] for r in rule_rows()}) < 60
