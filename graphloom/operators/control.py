"""Control flow and function summaries: branch points, paths, depth, effects, throws, summary differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import any_of
from ..plans.lineage import cut
from .functions import following, solved

# What code does to the world, by kind.
EFFECTS = [
    ("db_read", [r"\.find\w*\(", r"\.select\(", r"\.query\(", r"\.get\w*\(", r"(?i)SELECT\s", r"\.aggregate\(", r"\.count\("]),
    ("db_write", [r"\.save\(", r"\.insert\(", r"\.update\(", r"\.delete\(", r"\.create\(", r"\.remove\(", r"(?i)INSERT\s", r"(?i)UPDATE\s", r"(?i)DELETE\s", r"\.upsert\("]),
    ("api_call", [r"fetch\(", r"axios\.\w+\(", r"\.request\(", r"http\.\w+\(", r"\.send\(", r"res\.json\(", r"res\.send\(", r"res\.status\("]),
    ("file_io", [r"fs\.\w+", r"readFile", r"writeFile", r"createReadStream", r"createWriteStream", r"open\(", r"\.read\(", r"\.write\("]),
    ("log", [r"console\.\w+\(", r"logger\.\w+\(", r"log\.\w+\(", r"logging\.\w+\(", r"print\("]),
    ("env_read", [r"process\.env", r"os\.environ", r"getenv\(", r"Env\.\w+"]),
    ("cache_access", [r"cache\.\w+\(", r"redis\.\w+\(", r"memcache\.\w+\(", r"\.setex\(", r"\.getdel\("]),
    ("event_emit", [r"\.emit\(", r"\.dispatch\(", r"\.publish\(", r"EventEmitter", r"\.trigger\("]),
]

# What to do about a finding, by category.
FIXES = {
    "sql_injection": "Use parameterized queries instead of string concatenation",
    "xss": "Sanitize user input before rendering in HTML: use escapeHtml() or a template engine",
    "command_injection": "Use allowlist validation or avoid dynamic command construction",
    "path_traversal": 'Validate and normalize file paths; reject paths containing ".."',
    "pii_leak": "Mask or redact PII before logging; use structured logging with field-level control",
    "ssrf": "Validate and allowlist target URLs; avoid user-controlled URL construction",
    "open_redirect": "Validate redirect targets against an allowlist of safe domains",
    "log_injection": "Sanitize log input to prevent control character injection",
    "prototype_pollution": "Use Object.create(null) or validate property names before dynamic assignment",
    "insecure_deserialization": "Validate deserialized data structure; prefer JSON over binary serialization",
}


def effects(code: DataFrame) -> DataFrame:
    """fn, kind, target of code (fn, code): each kind of effect a line has, once per function, kind and target."""
    kinds = F.array_compact(F.array(*[F.when(any_of(F.col("code"), p), F.lit(k)) for k, p in EFFECTS]))
    return code.select("fn", F.explode(kinds).alias("kind"), F.col("code").alias("target")).distinct()


def suggest_fix(category: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FIXES.items() for x in kv]), category), F.lit("Review and validate untrusted input before use"))


def throw_type(code: Column) -> Column:
    found = [F.regexp_extract(code, p, 1) for p in (r"throw\s+new\s+(\w+)", r"raise\s+(\w+)")]
    return F.coalesce(*[F.when(x != "", x) for x in found], F.lit("Error"))


def literal_type(kind: Column) -> Column:
    same = {
        "string": "string", "template_string": "string", "number": "number", "integer": "number", "float": "number", "true": "boolean", "false": "boolean", "null": "null",
        "undefined": "undefined", "array": "array", "list": "array", "object": "object", "dictionary": "object",
    }
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in same.items() for x in kv]), kind)


def branch_points(edges: DataFrame) -> DataFrame:
    """fn, block and ways of blocks with more than one way out."""
    return edges.groupBy("fn", F.col("src").alias("block")).agg(F.count("*").alias("ways")).where("ways > 1")


def back_edges(edges: DataFrame) -> DataFrame:
    """fn, src, dst of edges that lead back to the head of a loop."""
    return edges.where("kind IN ('back', 'back_edge')").select("fn", "src", "dst")


def loop_nesting(edges: DataFrame, blocks: DataFrame, most: int = 10_000) -> DataFrame:
    """fn, block, nesting: the most loop headers on a way from the entry to each block, itself not counted; edges: fn, src, dst, kind; blocks: fn, block, is_entry, is_header.

    Edges that lead back are not followed, nor any that would close a ring.  By joins, for
    large functions, nesting is what most rounds find.
    """
    kind = blocks.schema["block"].dataType.simpleString()
    forward = edges.where("kind NOT IN ('back', 'back_edge')").select("fn", "src", "dst")

    def solve(own, ways):
        to, heads, deepest = following(ways), {b.block for b in own if b.is_header}, {}
        for entry in (b.block for b in own if b.is_entry):
            # nodes after all that they lead to, without a call for each
            order, state, stack = [], {entry: 0}, [(entry, iter(to.get(entry, ())))]
            skipped = set()
            while stack:
                at, left = stack[-1]
                for x in left:
                    if x not in state:
                        state[x] = 0
                        stack.append((x, iter(to.get(x, ()))))
                        break
                    if state[x] == 0:
                        skipped.add((at, x))
                else:
                    state[at] = 1
                    order.append(at)
                    stack.pop()
            depth = {entry: 0}
            for at in reversed(order):
                for x in to.get(at, ()):
                    if (at, x) not in skipped:
                        depth[x] = max(depth.get(x, 0), depth[at] + (at in heads))
            for x, d in depth.items():
                deepest[x] = max(deepest.get(x, 0), d)
        return list(deepest.items())

    def by_joins(own, ways):
        heads = own.where("is_header").select("fn", F.col("block").alias("src"), F.lit(1).alias("more"))
        steps = cut(ways.join(heads, ["fn", "src"], "left").select("fn", "src", "dst", F.coalesce("more", F.lit(0)).alias("more")))
        known = cut(own.where("is_entry").select("fn", "block", F.lit(0).alias("nesting")))
        for _ in range(most):
            new = known.withColumnRenamed("block", "src").join(steps, ["fn", "src"]).select("fn", F.col("dst").alias("block"), (F.col("nesting") + F.col("more")).alias("nesting"))
            both = known.union(new).groupBy("fn", "block").agg(F.max("nesting").alias("nesting"))
            both = cut(both)
            if both.join(known, ["fn", "block", "nesting"], "left_anti").isEmpty():
                break
            known = both
        return known

    return solved(blocks.select("fn", "block", "is_entry", "is_header"), forward, solve, f"fn {blocks.schema['fn'].dataType.simpleString()}, block {kind}, nesting int", by_joins)


def summaries(functions: DataFrame, flows: DataFrame, effects_: DataFrame, throws: DataFrame, returns: DataFrame, complexity: DataFrame) -> DataFrame:
    """A row for each function (fn): flows (params, targets and whether made safe), effects (kind and target), throws, can_return_null, can_return_undefined, cyclomatic and cognitive.

    flows: fn, param, id, sanitized; effects_: fn, kind, target; throws: fn, type; returns:
    fn, text; complexity: fn, cyclomatic, cognitive.  Each list is one function's.
    """
    text = F.trim("text")
    empty = F.col("text").isNull() | (text == "")
    null = text.rlike(r"^return\s+(?:null|None|nil)\b")
    undefined = text.rlike(r"^return\s*(?:undefined)?\s*;?$")
    told = returns.groupBy("fn").agg(F.bool_or(~empty & null).alias("can_return_null"), F.bool_or(empty | undefined).alias("can_return_undefined"))
    lists = [
        flows.groupBy("fn").agg(F.sort_array(F.collect_set(F.struct("param", "id", "sanitized"))).alias("flows")),
        effects_.groupBy("fn").agg(F.sort_array(F.collect_set(F.struct("kind", "target"))).alias("effects")),
        throws.groupBy("fn").agg(F.sort_array(F.collect_set("type")).alias("throws")),
        told, complexity.select("fn", "cyclomatic", "cognitive"),
    ]
    rows = functions.select("fn")
    for part in lists:
        rows = rows.join(part, "fn", "left")
    no = F.lit(False)
    return rows.withColumns({"can_return_null": F.coalesce("can_return_null", no), "can_return_undefined": F.coalesce("can_return_undefined", no), "cyclomatic": F.coalesce("cyclomatic", F.lit(1)), "cognitive": F.coalesce("cognitive", F.lit(0))})


def simple_paths(edges: DataFrame, ends: DataFrame, most: int = 100, large: int | None = None) -> DataFrame:
    """fn, path: paths without repeats from entry to exit, at most `most` of a function (the lexically first); edges: fn, src, dst; ends: fn, entry, exit."""
    kind = ends.schema["entry"].dataType.simpleString()

    def solve(own, ways):
        out = []
        to = {a: sorted(held) for a, held in following(ways).items()}
        for end in own:
            found, path, on = 0, [end.entry], {end.entry}
            stack = [iter(() if end.entry == end.exit else to.get(end.entry, ()))]
            if end.entry == end.exit:
                out.append(([end.entry],))
                continue
            while stack and found < most:
                x = next(stack[-1], None)
                if x is None:
                    stack.pop()
                    on.discard(path.pop())
                elif x == end.exit:
                    out.append(([*path, x],))
                    found += 1
                elif x not in on:
                    path.append(x)
                    on.add(x)
                    stack.append(iter(to.get(x, ())))
        return out

    def by_joins(own, ways):
        return _paths_by_joins(ways, own, most)

    return solved(ends.select("fn", "entry", "exit"), edges.select("fn", "src", "dst"), solve, f"fn {ends.schema['fn'].dataType.simpleString()}, path array<{kind}>", by_joins, large)


def _paths_by_joins(edges: DataFrame, ends: DataFrame, most: int) -> DataFrame:
    """simple_paths() by joins; of the paths under way of one length it keeps the lexically first `most`."""
    open_ = cut(ends.select("fn", "exit", F.array("entry").alias("path")))
    done = []
    while True:
        last = F.element_at("path", -1)
        done.append(cut(open_.where(last == F.col("exit")).select("fn", "path")))
        grow = open_.where(last != F.col("exit")).withColumn("src", last).join(edges, ["fn", "src"]).where(~F.array_contains("path", F.col("dst")))
        open_ = cut(grow.select("fn", "exit", F.concat("path", F.array("dst")).alias("path")).transform(lambda d: _first(d, most)))
        if open_.isEmpty():
            return _first(reduce(DataFrame.unionByName, done), most)


def _first(rows: DataFrame, most: int) -> DataFrame:
    from pyspark.sql import Window

    return rows.withColumn("__r", F.row_number().over(Window.partitionBy("fn").orderBy("path"))).where(F.col("__r") <= most).drop("__r")


def block_depths(edges: DataFrame, entries: DataFrame, nesting: DataFrame, large: int | None = None) -> DataFrame:
    """fn, block, depth: nesting blocks before a block on the way it is first reached; edges: fn, src, dst; entries: fn, block; nesting: fn, block.

    Of ways of the same length the one with the fewest nesting blocks counts.
    """
    kind = entries.schema["block"].dataType.simpleString()
    opens = nesting.select("fn", F.col("block").alias("src")).distinct().withColumn("more", F.lit(1))
    steps = edges.join(opens, ["fn", "src"], "left").select("fn", "src", "dst", F.coalesce("more", F.lit(0)).alias("more"))

    def solve(own, ways):
        to, depth = following(ways), {n.block: 0 for n in own}
        level = list(depth)
        while level:
            new: dict = {}
            for at in level:
                for x, e in to.get(at, {}).items():
                    if x not in depth:
                        new[x] = min(new.get(x, 1 << 60), depth[at] + e.more)
            depth |= new
            level = list(new)
        return list(depth.items())

    return solved(entries.select("fn", "block"), steps, solve, f"fn {entries.schema['fn'].dataType.simpleString()}, block {kind}, depth int", _depths_by_joins, large)


def _depths_by_joins(entries: DataFrame, steps: DataFrame) -> DataFrame:
    steps = cut(steps)
    frontier = cut(entries.select("fn", "block", F.lit(0).alias("depth")))
    parts = [frontier]
    while True:
        seen = reduce(DataFrame.unionByName, parts).select("fn", "block")
        new = frontier.withColumnRenamed("block", "src").join(steps, ["fn", "src"]).select("fn", F.col("dst").alias("block"), (F.col("depth") + F.col("more")).alias("depth"))
        new = cut(new.join(seen, ["fn", "block"], "left_anti").groupBy("fn", "block").agg(F.min("depth").alias("depth")))
        if new.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        parts.append(new)
        frontier = new


def param_flows(edges: DataFrame, params: DataFrame, large: int | None = None) -> DataFrame:
    """fn, param, id, sanitized: where parameters flow, over edges of all kinds; edges: fn, src, dst, transform; params: fn, id.

    Sanitised where a transform on some shortest way validates, sanitises, escapes or encodes.
    """
    kind = params.schema["id"].dataType.simpleString()
    safe = F.coalesce(F.lower("transform").rlike("validate|sanitize|escape|encode"), F.lit(False))
    jumps = edges.groupBy("fn", "src", "dst").agg(F.bool_or(safe).alias("safe"))

    def solve(own, ways):
        to, out = following(ways), []
        for start in own:
            known, level = {start.id: False}, [start.id]
            while level:
                new: dict = {}
                for at in level:
                    for x, e in to.get(at, {}).items():
                        if x not in known:
                            new[x] = new.get(x, False) or known[at] or bool(e.safe)
                known |= new
                level = list(new)
            out += [(start.id, x, s) for x, s in known.items() if x != start.id]
        return out

    schema = f"fn {params.schema['fn'].dataType.simpleString()}, param {kind}, id {kind}, sanitized boolean"
    return solved(params.select("fn", "id"), jumps, solve, schema, _flows_by_joins, large)


def _flows_by_joins(params: DataFrame, jumps: DataFrame) -> DataFrame:
    """param_flows() by joins.

    Jumps of 1, 2, 4 and so on edges extend all that is known, so rounds grow with the
    logarithm of the longest way.
    """
    jumps = cut(jumps)
    parts = [cut(params.select("fn", F.col("id").alias("param"), "id", F.lit(0).cast("long").alias("far"), F.lit(False).alias("sanitized")))]
    while True:
        known = reduce(DataFrame.unionByName, parts)
        new = known.withColumnRenamed("id", "src").join(jumps, ["fn", "src"]).select("fn", "param", F.col("dst").alias("id"), (F.col("far") + (1 << len(parts) - 1)).alias("far"), (F.col("sanitized") | F.col("safe")).alias("sanitized"))
        new = new.join(known.select("fn", "param", "id"), ["fn", "param", "id"], "left_anti").groupBy("fn", "param", "id", "far").agg(F.bool_or("sanitized").alias("sanitized"))
        # only the shortest ways count
        new = new.groupBy("fn", "param", "id").agg(F.min(F.struct("far", "sanitized")).alias("first"))
        new = cut(new.select("fn", "param", "id", "first.far", "first.sanitized"))
        if new.isEmpty():
            return known.where("param <> id").drop("far")
        parts.append(new)
        on = jumps.select("fn", F.col("src").alias("by"), "dst", F.col("safe").alias("more"))
        jumps = cut(jumps.withColumnRenamed("dst", "by").join(on, ["fn", "by"]).groupBy("fn", "src", "dst").agg(F.bool_or(F.col("safe") | F.col("more")).alias("safe")))


def compare_summaries(base: DataFrame, changed: DataFrame) -> DataFrame:
    """name, added, removed (effects), null_changed of summaries (name, effects ARRAY<STRING>, can_return_null) that differ.

    Where both have them, flows (ARRAY<STRING>) and can_return_undefined are compared alike: flows_added, flows_removed, undefined_changed.
    """
    has = lambda c: c in base.columns and c in changed.columns
    b = base.select("name", *[F.col(c).alias(f"old_{c}") for c in base.columns if c != "name"])
    no = F.lit(False)
    differ = lambda c: F.col(f"old_{c}") != F.col(c)
    found = {"added": F.array_except("effects", "old_effects"), "removed": F.array_except("old_effects", "effects"), "null_changed": differ("can_return_null")}
    if has("flows"):
        found |= {"flows_added": F.array_except("flows", "old_flows"), "flows_removed": F.array_except("old_flows", "flows")}
    if has("can_return_undefined"):
        found["undefined_changed"] = differ("can_return_undefined")
    rows = b.join(changed, "name").select("name", *[v.alias(k) for k, v in found.items()])
    for k in found:
        no = no | (F.col(k) if k.endswith("changed") else F.size(k) > 0)
    return rows.where(no)


def merge_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The differences of two branches as one: unions of effects; null where either changed it."""
    x, y = a.select("name", *[F.col(c).alias(f"a_{c}") for c in ("added", "removed", "null_changed")]), b
    none = F.array().cast("array<string>")
    both = x.join(y, "name", "full")
    union = lambda c: F.array_union(F.coalesce(f"a_{c}", none), F.coalesce(c, none)).alias(c)
    null = F.coalesce("a_null_changed", F.lit(False)) | F.coalesce("null_changed", F.lit(False))
    return both.select("name", union("added"), union("removed"), null.alias("null_changed"))


def community_labels(members: DataFrame) -> DataFrame:
    """community, label of members (community, id, ord, kind, name, file_path): shared folder, class, prefix of names, or kind and size.

    The folder is the deepest that holds at least three fifths of the members.
    """
    size = members.groupBy("community").agg(F.count("*").alias("size"))
    parts = F.slice(F.split("file_path", "/"), 1, F.greatest(F.size(F.split("file_path", "/")) - 1, F.lit(0)))
    prefix = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice(F.col("parts"), 1, i), "/"))
    dirs = members.select("community", parts.alias("parts")).where("size(parts) > 0").select("community", F.explode(prefix).alias("dir"))
    held = dirs.groupBy("community", "dir").agg(F.count("*").alias("n")).join(size, "community").where(F.col("n") >= F.col("size") * 0.6)
    folder = held.groupBy("community").agg(F.max_by("dir", F.struct(F.size(F.split("dir", "/")), "n")).alias("dir"))
    cap = lambda c: F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))
    common = lambda low, high: F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.least(F.length(low), F.length(high))), lambda i: low.substr(F.lit(1), i) == high.substr(F.lit(1), i)), lambda i: low.substr(i, F.lit(1))), "")
    classes = members.where(F.col("kind").isin("class", "interface", "struct")).groupBy("community").agg(F.count("*").alias("nc"), F.min("name").alias("lo"), F.max("name").alias("hi"), F.min_by("name", "ord").alias("first"))
    fns = members.where(F.col("kind").isin("function", "method")).groupBy("community").agg(F.count("*").alias("nf"), F.min("name").alias("flo"), F.max("name").alias("fhi"))
    kinds = members.groupBy("community", "kind").agg(F.count("*").alias("n"), F.min("ord").alias("o")).groupBy("community").agg(F.max_by("kind", F.struct("n", -F.col("o"))).alias("kind"))
    rows = size.join(folder, "community", "left").join(classes, "community", "left").join(fns, "community", "left").join(kinds, "community")
    shared, fshared = common(F.col("lo"), F.col("hi")), common(F.col("flo"), F.col("fhi"))
    label = F.coalesce(
        cap(F.element_at(F.split("dir", "/"), -1)), F.when((F.col("nc") > 1) & (F.length(shared) >= 3), F.concat(shared, F.lit("*"))), F.col("first"),
        F.when((F.col("nf") > 1) & (F.length(fshared) >= 3), F.concat(cap(fshared), F.lit("*"))), F.concat(cap(F.col("kind")), F.lit(" Group ("), F.col("size").cast("string"), F.lit(")")),
    )
    return rows.select("community", label.alias("label"))
