"""Reachability that remembers where it began: transitive collisions, source-to-sink flows, re-exports, look-ups, import resolution."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolode.operators.ordered import numbered
from cartolode.sources.tables import save


class Reach:
    """What each of seeds(seed) reaches along edges(src, dst) within so many hops, as bitmaps: of each hop a written table
    (node, block, bits) with a bit for every seed that reaches the node at that hop first; a block has 64 seeds. Nodes of
    stop(node) are reached but not passed through, but for seeds. No row stands for a single seed and node, and ways are kept
    as hops only.
    """

    def __init__(self, edges: DataFrame, seeds: DataFrame, max_distance: int, stop: DataFrame | None = None):
        self.steps = save(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct(), "steps")
        number = F.monotonically_increasing_id()
        self.seeds = save(seeds.select("seed").where("seed is not null").distinct().withColumn("number", number), "seeds")
        bit = F.expr("shiftleft(1L, cast(number % 64 as int))")
        self.seeds = self.seeds.select("seed", F.floor(F.col("number") / 64).alias("block"), bit.alias("bit"))
        self.stop = stop
        self.hops = [save(self.seeds.select(F.col("seed").alias("node"), "block", F.col("bit").alias("bits")), "hop")]
        for _ in range(max_distance):
            frontier = save(self._next(), "hop")
            if frontier.isEmpty():
                break
            self.hops.append(frontier)

    def going(self, hop: int) -> DataFrame:
        """What goes on from a hop: a seed does even if it is a stop."""
        return self.hops[hop] if self.stop is None or not hop else self.hops[hop].join(self.stop.select("node"), "node", "left_anti")

    def _next(self) -> DataFrame:
        met = self.going(len(self.hops) - 1).join(self.steps, "node").select(F.col("to").alias("node"), "block", F.col("bits").alias("new"), F.lit(0).cast("long").alias("old"))
        seen = reduce(DataFrame.unionByName, self.hops).select("node", "block", F.lit(0).cast("long").alias("new"), F.col("bits").alias("old"))
        both = met.unionByName(seen).groupBy("node", "block").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        return both.select("node", "block", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("bits")).where("bits <> 0")

    def pairs(self, nodes: DataFrame, least: int = 0) -> DataFrame:
        """(seed, node, distance) of the pairs with one of nodes(node) that are so far apart at least."""
        far = [h.select("node", "block", "bits", F.lit(k).alias("distance")) for k, h in enumerate(self.hops) if k >= least]
        if not far:
            return self.hops[0].limit(0).select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"))
        ends = reduce(DataFrame.unionByName, far).join(nodes.select("node").distinct(), "node", "left_semi")
        met = ends.join(self.seeds, "block").where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        return met.select("seed", "node", "distance")

    def paths(self, ends: DataFrame) -> DataFrame:
        """ends(seed, node, distance) with path, the nodes of a shortest way joined by `>`, the smallest of those in order.

        Backwards, hop by hop, the nodes on any shortest way of a pair are those before it that the seed reached a hop
        earlier; forwards the smallest next of them is taken.
        """
        ends = save(ends.withColumn("pair", F.monotonically_increasing_id()).join(self.seeds, "seed"), "ends")
        on: dict[int, DataFrame] = {}
        for hop in range(len(self.hops) - 1, -1, -1):
            at = ends.where(F.col("distance") == hop).select("pair", "block", "bit", "node")
            if hop + 1 in on:
                back = on[hop + 1].withColumnRenamed("node", "to").join(self.steps, "to").join(self.going(hop), ["node", "block"])
                at = at.unionByName(back.where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("pair", "block", "bit", "node").distinct())
            on[hop] = save(at, "ways")
        now = on[0].select("pair", "node")
        chosen = [now.withColumn("hop", F.lit(0))]
        for hop in range(1, len(self.hops)):
            further = on[hop].select("pair", F.col("node").alias("to"))
            now = save(now.join(self.steps, "node").join(further, ["pair", "to"]).groupBy("pair").agg(F.min("to").alias("node")), "way")
            chosen.append(now.withColumn("hop", F.lit(hop)))
        whole = reduce(DataFrame.unionByName, chosen).groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("hop", "node"))).alias("way"))
        path = F.array_join(F.transform("way", lambda x: x["node"].cast("string")), ">")
        return ends.join(whole, "pair").select("seed", "node", "distance", path.alias("path"))


def nearest(edges: DataFrame, seeds: DataFrame, max_distance: int) -> DataFrame:
    """(node, seed, distance): the nearest of seeds(seed) along edges(src, dst), the smallest of those as near. What a node has
    nearest, one before it has nearest a hop less, so a row a node is all that is kept."""
    steps = save(edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct(), "steps")
    parts = [save(seeds.select(F.col("seed").alias("node"), "seed").where("seed is not null").distinct().withColumn("distance", F.lit(0)), "near")]
    for hop in range(1, max_distance + 1):
        met = parts[-1].join(steps, "node").groupBy(F.col("to").alias("node")).agg(F.min("seed").alias("seed"))
        new = save(met.join(reduce(DataFrame.unionByName, parts), "node", "left_anti").withColumn("distance", F.lit(hop)), "near")
        if new.isEmpty():
            break
        parts.append(new)
    return reduce(DataFrame.unionByName, parts)


def _kinds(work: DataFrame) -> tuple[DataFrame, DataFrame]:
    """paths(path, kind) of work(path, stream) and kinds(kind, streams): a number for each set of streams that some path has."""
    sets = work.where("path is not null and stream is not null").groupBy("path").agg(F.sort_array(F.collect_set("stream")).alias("streams"))
    sets = save(sets, "streams")
    kinds = save(sets.select("streams").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    return save(sets.join(kinds, "streams").select("path", "kind"), "paths"), kinds


def _reached(steps: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """(end, kind, node, hop) of the nodes that ends(end, kind) reach along steps(node, to) within so many hops, the fewest of each."""
    parts = [ends.select("end", "kind", F.col("end").alias("node"), F.lit(0).alias("hop"))]
    for hop in range(1, most + 1):
        met = parts[-1].join(steps, "node").select("end", "kind", F.col("to").alias("node"), F.lit(hop).alias("hop"))
        first = reduce(DataFrame.unionByName, [met, *parts]).groupBy("end", "kind", "node").agg(F.min("hop").alias("hop"))
        parts.append(save(first.where(F.col("hop") == hop), "reached"))
    return reduce(DataFrame.unionByName, parts)


def collisions_transitive(work: DataFrame, edges: DataFrame, max_distance: int = 5) -> DataFrame:
    """A file of one stream that depends over two hops or more on a file of another, each changed by one of the two
    streams only: (stream_a, stream_b, file_a, file_b, distance) with the nearest distance of each pair.

    Each end is followed half the distance and the rest back from the other, and met in the middle. Of two files both directions are
    told together, once, with numbers for the sets of streams that change them, from which the rows are told last.
    """
    paths, kinds = _kinds(work)
    ends, half = paths.withColumnRenamed("path", "end"), (max_distance + 1) // 2
    back = save(edges.select(F.col("dst").alias("node"), F.col("src").alias("to")).where("node is not null and to is not null").distinct(), "steps")
    there = _reached(back, ends, half)
    here = _reached(back.select(F.col("to").alias("node"), F.col("node").alias("to")), ends, max_distance - half)
    there = there.select(F.col("end").alias("seed"), F.col("kind").alias("seed_kind"), "node", "hop")
    here = here.select("end", F.col("kind").alias("end_kind"), "node", F.col("hop").alias("rest"))
    # A pair nearer than the middle is met at its end.
    met = there.join(here, "node").where((F.col("rest") == 0) | (F.col("hop") == half)).where("seed <> end")
    up, far = F.col("seed") < F.col("end"), F.col("hop") + F.col("rest")
    pick = lambda c, a, b: F.when(c, F.col(a)).otherwise(F.col(b))
    sides = [pick(up, "seed", "end").alias("low"), pick(up, "end", "seed").alias("high"), pick(up, "seed_kind", "end_kind").alias("low_kind"), pick(up, "end_kind", "seed_kind").alias("high_kind")]
    met = met.select(*sides, F.when(up, far).alias("up"), F.when(~up, far).alias("down"))
    near = met.groupBy("low", "high", "low_kind", "high_kind").agg(F.min("up").alias("up"), F.min("down").alias("down"))
    distance = F.least(F.when(F.col("up") >= 2, F.col("up")), F.when(F.col("down") >= 2, F.col("down")))
    near = near.select("low", "high", "low_kind", "high_kind", distance.alias("distance")).where("distance is not null")
    kinds = F.broadcast(kinds) if kinds.limit(ALIASES + 1).count() <= ALIASES else kinds
    for side in ("low", "high"):
        near = near.join(kinds.select(F.col("kind").alias(f"{side}_kind"), F.col("streams").alias(f"{side}_streams")), f"{side}_kind")
    rows = near.withColumn("s", F.explode(F.array_except("low_streams", "high_streams"))).withColumn("t", F.explode(F.array_except("high_streams", "low_streams")))
    first = F.col("s") < F.col("t")
    return rows.select(pick(first, "s", "t").alias("stream_a"), pick(first, "t", "s").alias("stream_b"), pick(first, "low", "high").alias("file_a"), pick(first, "high", "low").alias("file_b"), "distance")


def _steps(calls: DataFrame) -> DataFrame:
    return save(calls.select(F.col("src").alias("node"), F.col("dst").alias("to")).where("node is not null and to is not null").distinct(), "steps")


def _ends(sources: DataFrame, sinks: DataFrame) -> list[DataFrame]:
    return [save(x.select(F.col("node").alias("end")).where("end is not null").distinct(), "ends") for x in (sources, sinks)]


def _ways(steps: DataFrame, ends: DataFrame, most: int, stop: DataFrame, forward: bool) -> list[DataFrame]:
    """Of each of so many hops from ends(end) a written table (end, node, path) of the nodes first reached along steps(node, to),
    with the smallest of their ways as a list in the order of steps. Nodes of stop(node) are not passed through; forward, ends may be."""
    parts = [save(ends.select("end", F.col("end").alias("node"), F.array("end").alias("path")), "ways")]
    for hop in range(1, most + 1):
        at, to = ("node", "to") if forward else ("to", "node")
        met = parts[-1].withColumnRenamed("node", at).join(steps, at)
        if forward:
            met = met if hop == 1 else met.join(stop, "node", "left_anti")
        else:
            met = met.join(stop, "node", "left_anti")
        met = met.select("end", F.col(to).alias("node"), "path").groupBy("end", "node").agg(F.min("path").alias("path"))
        own = F.array("node")
        whole = F.concat("path", own) if forward else F.concat(own, "path")
        seen = reduce(DataFrame.unionByName, parts).select("end", "node")
        parts.append(save(met.join(seen, ["end", "node"], "left_anti").select("end", "node", whole.alias("path")), "ways"))
        if parts[-1].isEmpty():
            break
    return parts


def taint_flows(calls: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 12) -> DataFrame:
    """(source, sink, depth, path): each sink that a source(node) reaches over calls(src, dst) without passing another sink, with
    the nodes of a shortest way joined by `>`, the smallest of those in order.

    Ways are followed for half the depth from the sources and for the rest back from the sinks, and joined at the nodes in the
    middle: a smallest way is a smallest way to its middle and one from there. A pair is told once, not hop by hop.
    """
    steps, ends = _steps(calls), _ends(sources, sinks)
    stop, half = ends[1].withColumnRenamed("end", "node"), (max_depth + 1) // 2
    there = _ways(steps, ends[0], half, stop, True)
    hits = [p.join(stop, "node", "left_semi").select(F.col("end").alias("source"), F.col("node").alias("sink"), "path") for p in there]
    if len(there) == half + 1 and max_depth > half:
        middle = (there[half].join(stop, "node", "left_anti") if half else there[half]).select(F.col("end").alias("source"), "node", F.col("path").alias("head"))
        back = reduce(DataFrame.unionByName, _ways(steps, ends[1], max_depth - half, stop, False)[1:])
        tail = back.select("node", F.col("end").alias("sink"), F.slice("path", 2, max_depth + 1).alias("tail"))
        hits.append(middle.join(tail, "node").select("source", "sink", F.concat("head", "tail").alias("path")))
    way = F.min(F.struct((F.size("path") - 1).alias("depth"), "path")).alias("way")
    found = reduce(DataFrame.unionByName, hits).groupBy("source", "sink").agg(way)
    path = F.array_join(F.transform("way.path", lambda x: x.cast("string")), ">")
    return found.select("source", "sink", F.col("way.depth").alias("depth"), path.alias("path"))


def _levels(steps: DataFrame, ends: DataFrame, most: int, stop: DataFrame, forward: bool) -> list[DataFrame]:
    """_ways without the ways: of each hop a written table (end, node)."""
    parts = [save(ends.select("end", F.col("end").alias("node")), "levels")]
    at, to = ("node", "to") if forward else ("to", "node")
    for hop in range(1, most + 1):
        met = parts[-1].withColumnRenamed("node", at).join(steps, at)
        met = met if forward and hop == 1 else met.join(stop, "node", "left_anti")
        met = met.select("end", F.col(to).alias("node")).distinct()
        parts.append(save(met.join(reduce(DataFrame.unionByName, parts), ["end", "node"], "left_anti"), "levels"))
        if parts[-1].isEmpty():
            break
    return parts


def _depths(steps: DataFrame, ends: list[DataFrame], max_depth: int) -> DataFrame:
    """(source, sink, depth) of taint_flows, which meets in the middle alike but carries no ways: a pair is two nodes and a number."""
    stop, half = ends[1].withColumnRenamed("end", "node"), (max_depth + 1) // 2
    there = _levels(steps, ends[0], half, stop, True)
    hits = [p.join(stop, "node", "left_semi").select(F.col("end").alias("source"), F.col("node").alias("sink"), F.lit(k).alias("depth")) for k, p in enumerate(there)]
    if len(there) == half + 1 and max_depth > half:
        back = _levels(steps, ends[1], max_depth - half, stop, False)
        tail = reduce(DataFrame.unionByName, [p.select("node", F.col("end").alias("sink"), F.lit(half + k).alias("depth")) for k, p in enumerate(back)][1:])
        middle = there[half].join(stop, "node", "left_anti").select(F.col("end").alias("source"), "node")
        hits.append(middle.join(tail, "node").select("source", "sink", "depth"))
    return reduce(DataFrame.unionByName, hits).groupBy("source", "sink").agg(F.min("depth").alias("depth"))


def _bridges(steps: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int) -> DataFrame:
    """dataflow_bridges over written steps(node, to), with the distance to either end."""
    back = steps.select(F.col("to").alias("src"), F.col("node").alias("dst"))
    ends = []
    for kind, nodes in (("source", sources), ("sink", sinks)):
        far = nearest(back, nodes.select(F.col("node").alias("seed")), max_depth).where("distance >= 1")
        ends.append(far.select(F.col("node").alias("bridge"), F.col("seed").alias(kind), F.col("distance").alias(f"{kind}_distance")))
    rows = ends[0].join(ends[1], "bridge").where("source <> sink")
    for nodes in (sources, sinks):
        rows = rows.join(nodes.select(F.col("node").alias("bridge")), "bridge", "left_anti")
    return rows


def dataflow_bridges(calls: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 3) -> DataFrame:
    """Functions that reach both a source and a sink over calls and are neither: (bridge, source, sink), nearest and smallest of each."""
    return _bridges(_steps(calls), sources, sinks, max_depth).select("bridge", "source", "sink")


def dataflow_risks(calls: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 12, bridge_depth: int = 3) -> DataFrame:
    """(kind, source, sink, bridge, confidence, severity): a function that is both ends is direct, one that reaches a sink over calls
    propagated, one that reaches both ends a bridge. Confidence is high over a call or less on every way, else medium. The calls
    are made once, for flows and bridges."""
    sure = lambda c: F.when(c, "high").otherwise("medium").alias("confidence")
    node = sources.schema["node"].dataType
    steps = _steps(calls)
    flows = _depths(steps, _ends(sources, sinks), max_depth)
    flows = flows.select(F.when(F.col("depth") == 0, "direct").otherwise("propagated").alias("kind"), "source", "sink", F.lit(None).cast(node).alias("bridge"), sure(F.col("depth") <= 1))
    near = (F.col("source_distance") == 1) & (F.col("sink_distance") == 1)
    rows = flows.unionByName(_bridges(steps, sources, sinks, bridge_depth).select(F.lit("bridge").alias("kind"), "source", "sink", "bridge", sure(near)))
    return rows.withColumn("severity", F.lit("error"))


def expand_reexports(exports: DataFrame, stars: DataFrame) -> DataFrame:
    """exports(path, name) with every name that stars(src re-exports all of dst) bring in, until nothing new comes.

    Names are bits: each round a path's new names, 64 to a word, go to those that re-export it, so that no row stands for a
    single path and name before the end. A round's table holds what every path has and which of it is new.
    """
    back = save(stars.select(F.col("dst").alias("path"), F.col("src").alias("to")).distinct(), "stars")
    own = save(exports.select("path", "name").distinct(), "exports")
    names = save(numbered(own.select("name").distinct(), ["name"], "number"), "names")
    names = names.select(F.col("name").alias("known"), F.floor((F.col("number") - 1) / 64).alias("block"), F.expr("shiftleft(1L, cast((number - 1) % 64 as int))").alias("bit"))
    bits = own.join(names, F.col("name").eqNullSafe(F.col("known"))).groupBy("path", "block").agg(F.bit_or("bit").alias("bits"))
    state = save(bits.withColumn("new", F.col("bits")), "names")
    while not (moving := state.where("new <> 0")).isEmpty():
        met = moving.join(back, "path").select(F.col("to").alias("path"), "block", F.lit(0).cast("long").alias("bits"), "new")
        both = met.unionByName(state.select("path", "block", "bits", F.lit(0).cast("long").alias("new"))).groupBy("path", "block").agg(F.bit_or("bits").alias("bits"), F.bit_or("new").alias("new"))
        state = save(both.select("path", "block", F.col("bits").bitwiseOR(F.col("new")).alias("bits"), F.col("new").bitwiseAND(F.bitwise_not("bits")).alias("new")), "names")
    return state.join(names, "block").where(F.col("bits").bitwiseAND(F.col("bit")) != 0).select("path", F.col("known").alias("name"))


def neighbours(edges: DataFrame, nodes: DataFrame, direction: str = "importers") -> DataFrame:
    """(path, neighbour) of nodes(path): what they import, or what imports them."""
    here, there = ("dst", "src") if direction == "importers" else ("src", "dst")
    return edges.select(F.col(here).alias("path"), F.col(there).alias("neighbour")).distinct().join(nodes.select("path").distinct(), "path", "left_semi")


#: Path aliases and workspace packages are broadcast up to so many.
ALIASES = 100_000


def unalias(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """imports(path, spec) with at: spec with its longest prefix among aliases(prefix, target) put as target. A prefix is a whole
    number of parts of spec, as `@` of `@/x`, or a workspace package's name with its folder as target; ties go to the smaller
    target."""
    parts = F.split("spec", "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    specs = imports.select("spec").distinct()
    known = aliases.select("prefix", F.col("target").alias("folder"))
    known = F.broadcast(known) if known.limit(ALIASES + 1).count() <= ALIASES else known
    hits = specs.select("spec", F.explode(heads).alias("prefix")).join(known, "prefix")
    best = hits.groupBy("spec").agg(F.min(F.struct((-F.length("prefix")).alias("n"), "folder", "prefix")).alias("x"))
    rest = F.substring("spec", F.length("x.prefix") + 1, F.length("spec"))
    return imports.join(best, "spec", "left").select("path", "spec", F.coalesce(F.concat("x.folder", rest), F.col("spec")).alias("at"))


def resolve_imports(imports: DataFrame, files: DataFrame, suffixes: list[str], aliases: DataFrame | None = None) -> DataFrame:
    """imports(path, spec) to the first of spec with each suffix that is a file, else to the package that spec begins with:
    (path, spec, target, package), one of the last two null. With aliases(prefix, target), of paths or of workspace packages,
    the spec that unalias makes is looked for."""
    rows = imports.select("path", "spec", F.col("spec").alias("at")) if aliases is None else unalias(imports.select("path", "spec"), aliases)
    tries = rows.select("path", "spec", F.posexplode(F.array(*[F.concat("at", F.lit(s)) for s in suffixes])).alias("rank", "target"))
    found = tries.join(files.select(F.col("path").alias("target")).distinct(), "target")
    first = found.groupBy("path", "spec").agg(F.min_by("target", "rank").alias("target"))
    rows = imports.select("path", "spec").distinct().join(first, ["path", "spec"], "left")
    return rows.withColumn("package", F.when(F.col("target").isNull(), F.substring_index("spec", "/", 1)))


#: What each look-up finds: the kind of edge, the end that is asked for and the end that is found.
LOOK_UPS = {
    "imports": ("file", "start", "end"),
    "importers": ("file", "end", "start"),
    "exports": ("symbol", "start", "end"),
    "definitions": ("symbol", "end", "start"),
    "package_importers": ("package", "end", "start"),
}


def look_up(index: DataFrame, asked: DataFrame, what: str, limit: int = 500) -> DataFrame:
    """(name, found, truncated) for each of asked(name): the first of what edge_index's rows hold, in order, 1 to 500 of them."""
    kind, at, to = LOOK_UPS[what]
    limit = min(max(limit, 1), 500)
    rows = index.where(F.col("kind") == kind).select(F.col(at).alias("name"), F.col(to).alias("found")).distinct().join(asked.select("name").distinct(), "name", "left_semi")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("name").orderBy("found"))).where(F.col("place") <= limit + 1)
    more = rows.groupBy("name").agg((F.count("*") > limit).alias("truncated"))
    return rows.where(F.col("place") <= limit).join(more, "name").select("name", "found", "truncated")


def edge_index(resolved: DataFrame, exports: DataFrame) -> DataFrame:
    """The three indexes of a graph as one table (kind, start, end), kind being file, package or symbol, from resolve_imports'
    rows and exports(path, name). A reader prunes by kind."""
    edge = lambda df, kind, end: df.where(F.col(end).isNotNull()).select(F.lit(kind).alias("kind"), F.col("path").alias("start"), F.col(end).alias("end"))
    return edge(resolved, "file", "target").unionByName(edge(resolved, "package", "package")).unionByName(edge(exports, "symbol", "name")).distinct()


def fan_out(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """functions(fn, bare) with the count of distinct names that calls(src, dst) of them lead to, their own left out."""
    a, b = functions.select(F.col("fn").alias("src"), F.col("bare").alias("own")), functions.select(F.col("fn").alias("dst"), "bare")
    rows = calls.join(a, "src").join(b, "dst").where("bare <> own").groupBy(F.col("src").alias("fn")).agg(F.countDistinct("bare").alias("fan_out"))
    return functions.select("fn").join(rows, "fn", "left").fillna(0, ["fan_out"])


def cross_repo_importers(imports: DataFrame, files: DataFrame, top: int = 200) -> DataFrame:
    """imports(repo, path, resolved) of other repositories' files(repo, path), both without their extension, as a report of the
    first: (owner, target, repo, path, truncated)."""
    bare = lambda c: F.regexp_replace(F.col(c), r"(?<=[^/])\.[^./]+$", "")
    a = imports.select("repo", "path", bare("resolved").alias("key")).distinct()
    b = files.select(F.col("repo").alias("owner"), F.col("path").alias("target"), bare("path").alias("key")).distinct()
    # A target has an importer if one of its key's smallest and largest repository is another; the report's rows are of as many such targets.
    span = a.groupBy("key").agg(F.min("repo").alias("low"), F.max("repo").alias("high"))
    asked = b.join(span, "key").where("low <> owner or high <> owner").orderBy("owner", "target").limit(top + 1)
    rows = a.join(F.broadcast(asked), "key").where("repo <> owner").select("owner", "target", "repo", "path")
    first = save(rows.orderBy("owner", "target", "repo", "path").limit(top + 1), "importers")
    return first.crossJoin(F.broadcast(first.agg((F.count("*") > top).alias("truncated")))).orderBy("owner", "target", "repo", "path").limit(top)
