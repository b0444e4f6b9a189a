"""Import graphs: resolution of targets, degrees, reachability, cycles."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import module_key, normal_path
from ..tables import written


PYTHON_IMPORT = r"^\s*(?:from\s+([\w.]+)|import\s+([\w.]+))"
SCRIPT_IMPORT = r"""from\s+['"]([^'"]+)['"]|require\(\s*['"]([^'"]+)['"]"""


def import_targets(files: DataFrame) -> DataFrame:
    """files (repo_id, path, language, text): (repo_id, path, target): what each import statement names, with slashes between its parts. Paths that begin with a dot are
    taken from the file's folder."""
    rows = files.where(F.col("language").isin("python", "javascript", "typescript", "tsx")).select("repo_id", "path", "language", F.explode(F.split("text", "\n")).alias("line"))
    both = lambda p: F.concat(F.regexp_extract("line", p, 1), F.regexp_extract("line", p, 2))
    python = rows.where("language = 'python'").where(F.col("line").rlike(PYTHON_IMPORT)).select("repo_id", "path", F.replace(both(PYTHON_IMPORT), F.lit("."), F.lit("/")).alias("target"))
    names = F.filter(F.concat(F.regexp_extract_all("line", F.lit(SCRIPT_IMPORT), 1), F.regexp_extract_all("line", F.lit(SCRIPT_IMPORT), 2)), lambda x: F.length(x) > 0)
    script = rows.where("language <> 'python'").select("repo_id", "path", F.explode(names).alias("target"))
    near = F.col("target").startswith(".")
    script = script.withColumn("target", F.when(near, normal_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.col("target")))).otherwise(F.col("target")))
    return python.unionByName(script).select("repo_id", "path", F.regexp_replace(F.trim("target"), "^/+|/+$", "").alias("target")).where("target <> ''").distinct()


def import_edges(imports: DataFrame, files: DataFrame, parts: int = 4) -> DataFrame:
    """imports (repo_id, path, target) to files of the repository whose module path ends in the target (1 to `parts` segments) or, where none does, in its last segment.

    Of several, paths outside tests come first, then shallow, short, and lexicographic. A file doesn't import itself. Of the files of one ending only the best two
    are kept before imports meet them, as just one of them can be the importer itself."""
    pieces = F.split(module_key("path"), "/")
    keys = files.select("repo_id", F.col("path").alias("dst"), F.explode(F.sequence(F.lit(1), F.least(F.size(pieces), F.lit(parts)))).alias("n"), pieces.alias("pieces"))
    keys = keys.select("repo_id", "dst", F.array_join(F.slice("pieces", -F.col("n"), F.col("n")), "/").alias("key"), (F.size("pieces")).alias("depth"))
    best = Window.partitionBy("repo_id", "key").orderBy(F.col("dst").rlike(fixed.TEST_PATH).cast("int"), "depth", F.length("dst"), "dst")
    keys = keys.withColumn("place", F.row_number().over(best)).where("place <= 2").drop("depth")
    slashed = F.when(F.col("target").contains("/"), F.col("target")).otherwise(F.replace(F.col("target"), F.lit("."), F.lit("/")))
    wanted = imports.select("repo_id", F.col("path").alias("src"), slashed.alias("whole"))
    tries = wanted.withColumn("try", F.explode(F.array(F.struct(F.lit(1).alias("turn"), F.col("whole").alias("key")), F.struct(F.lit(2).alias("turn"), F.element_at(F.split("whole", "/"), -1).alias("key"))))).select("repo_id", "src", "whole", "try.turn", "try.key")
    met = tries.join(keys, ["repo_id", "key"])
    first = met.groupBy("repo_id", "src", "whole").agg(F.min("turn").alias("turn"))  # the whole target, if any file has it
    found = met.join(first, ["repo_id", "src", "whole", "turn"]).where("src <> dst")
    return found.groupBy("repo_id", "src", "whole").agg(F.min_by("dst", "place").alias("dst")).select("repo_id", "src", "dst").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(repo_id, node, fan_out, fan_in) over distinct edges (repo_id, src, dst)."""
    ends = edges.select("repo_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("repo_id", F.col("e.node").alias("node")).agg(F.sum("e.o").alias("fan_out"), F.sum("e.i").alias("fan_in"))


def hubs(edges: DataFrame, most: int = 5) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("fan_in"), "node"))
    return degrees(edges).where("fan_in > 0").withColumn("place", place).where(F.col("place") <= most).select("repo_id", "place", "node", "fan_in")


def mutual_imports(edges: DataFrame) -> DataFrame:
    """Cycles of two: (repo_id, a, b), a < b."""
    back = edges.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["repo_id", "src", "dst"], "left_semi").where("src < dst").select("repo_id", F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


def import_cycles(edges: DataFrame, limit: int = 10) -> DataFrame:
    """(repo_id, cycle): cycles that a depth-first walk in sorted order closes, at most `limit` a repository, as paths joined by ' -> '.

    Edges of one repository go to one task; a repository's files bound them."""
    import pandas as pd

    def walk(edges: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = {}
        for s, d in sorted(set(zip(edges["src"], edges["dst"]))):
            after.setdefault(s, []).append(d)
        done: set[str] = set()
        found: list[str] = []
        for root in sorted(after):
            if root in done:
                continue
            path, at, stack = [root], {root: 0}, [iter(after[root])]
            while stack and len(found) < limit:
                node = next(stack[-1], None)
                if node is None:
                    stack.pop()
                    left = path.pop()
                    del at[left]
                    done.add(left)
                elif node in at:
                    found.append(" -> ".join([*path[at[node] :], node]))
                elif node not in done:
                    at[node] = len(path)
                    path.append(node)
                    stack.append(iter(after.get(node, [])))
        return pd.DataFrame({"repo_id": [edges["repo_id"].iloc[0]] * len(found), "cycle": found})

    return edges.groupBy("repo_id").applyInPandas(walk, "repo_id string, cycle string")


def short_cycles(edges: DataFrame, limit: int = 10, longest: int = 8) -> DataFrame:
    """(repo_id, place, cycle): the `limit` shortest simple cycles of each repository, of at most `longest` edges, as paths joined by ' -> '; equally long ones in order of their text.

    For graphs of any size: paths grow by an edge a round, as rows, only inside strongly connected components and only over nodes behind their first, so each
    cycle is found once, from its smallest node. A repository leaves as soon as it has enough, so crowded components, which have many short ones, don't go on."""
    own = edges.select("repo_id", "src", "dst").distinct()
    part = strong_components(own)
    ends = [part.select("repo_id", F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("src", "dst")]
    inner = written(own.where("src <> dst").join(ends[0], ["repo_id", "src"]).join(ends[1], ["repo_id", "dst"]).where("of_src = of_dst").select("repo_id", "src", "dst"))
    text = lambda nodes: F.array_join(nodes, " -> ")
    found = written(own.where("src = dst").select("repo_id", F.lit(1).alias("n"), text(F.array("src", "dst")).alias("cycle")))
    paths = inner.where("dst > src").select("repo_id", F.array("src", "dst").alias("path"))
    for n in range(2, longest + 1):
        full = found.groupBy("repo_id").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") >= limit)
        paths = paths.join(full, "repo_id", "left_anti")
        grown = written(paths.withColumn("src", F.element_at("path", -1)).join(inner, ["repo_id", "src"]).where((F.col("dst") >= F.col("path")[0])).drop("src"))
        found = written(found.unionByName(grown.where(F.col("dst") == F.col("path")[0]).select("repo_id", F.lit(n).alias("n"), text(F.array_append("path", F.col("dst"))).alias("cycle"))))
        paths = grown.where(~F.array_contains("path", F.col("dst"))).select("repo_id", F.array_append("path", F.col("dst")).alias("path"))
        if n == longest or paths.isEmpty():
            break
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy("n", "cycle"))
    return found.withColumn("place", place).where(F.col("place") <= limit).select("repo_id", "place", "cycle")


def strong_components(edges: DataFrame) -> DataFrame:
    """(repo_id, node, component): the nodes that stand on cycles, with the smallest node of their strongly connected component. For graphs of any size: no
    repository is brought to one task.

    Chains, trees and rings are folded first, see _folded(), so their length doesn't tell in rounds. In what is left, nodes without edges in or out can't be on a cycle and go. Then each node
    learns the smallest node that reaches it, and backwards, among nodes with one such origin, which of them reach that origin: these are a component and leave. Last, folded nodes come back.
    Tables are written at each round, so lineage stays short."""
    left, folds = written(edges.select("repo_id", "src", "dst").where("src <> dst").distinct()), []
    size = left.count()
    while size:
        for back in (False, True):
            left, fold = _folded(left, back)
            folds += [fold] if fold else []
        if size == (size := left.count()):
            break
    found = edges.select("repo_id", F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    while not left.isEmpty():
        while True:  # trim
            entered, leaving = left.select("repo_id", F.col("dst").alias("src")).distinct(), left.select("repo_id", F.col("src").alias("dst")).distinct()
            inner = written(left.join(entered, ["repo_id", "src"], "left_semi").join(leaving, ["repo_id", "dst"], "left_semi").select("repo_id", "src", "dst"))
            if inner.count() == left.count():
                break
            left = inner
        nodes = left.select("repo_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
        origin = _spread(nodes.withColumn("value", F.col("node")), left.select("repo_id", F.col("src").alias("a"), F.col("dst").alias("b")))
        inside = left.join(origin.select("repo_id", F.col("node").alias("src"), F.col("value").alias("o")), ["repo_id", "src"]).join(origin.select("repo_id", F.col("node").alias("dst"), F.col("value").alias("p")), ["repo_id", "dst"]).where("o = p").select("repo_id", F.col("dst").alias("a"), F.col("src").alias("b"))
        roots = origin.select("repo_id", "node", F.when(F.col("node") == F.col("value"), F.col("node")).alias("value"))
        part = _spread(roots, inside).where("value is not null").select("repo_id", "node", F.col("value").alias("component"))
        found = written(found.unionByName(part))
        gone = part.select("repo_id", "node")
        left = written(left.join(gone.withColumnRenamed("node", "src"), ["repo_id", "src"], "left_anti").join(gone.withColumnRenamed("node", "dst"), ["repo_id", "dst"], "left_anti").select("repo_id", "src", "dst"))
    for fold in reversed(folds):
        found = _unfolded(found, *fold)
    least = found.groupBy("repo_id", "component").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return found.join(least, ["repo_id", "component"]).select("repo_id", "node", F.col("least").alias("component"))


def _folded(edges: DataFrame, back: bool):
    """Distinct edges without loops (repo_id, src, dst) with each node that has just one edge in (with back: out) folded into the first node up that edge, and so on, that has several or none; of a ring
    of such nodes the smallest one stays. Also what _unfolded() needs, None where no node goes.

    Whatever is on a cycle with a folded node passes through that root, as nothing else leads to the node. Nodes find their roots by doubling: rounds are the logarithm of the longest chain, or with
    rings of the number of such nodes."""
    a, b = ("dst", "src") if back else ("src", "dst")
    single = edges.groupBy("repo_id", F.col(b).alias("node")).agg(F.count(F.lit(1)).alias("n"), F.max(a).alias("at")).where("n = 1")
    steps = [written(single.select("repo_id", "node", "at", F.col("node").alias("least")))]  # at: 2^k edges up or the root; least: the smallest node before it
    n = steps[0].count()
    if not n:
        return edges, None
    while True:
        there = steps[-1].select("repo_id", F.col("node").alias("at"), F.col("at").alias("further"), F.col("least").alias("least_there"))
        met = steps[-1].join(there, ["repo_id", "at"], "left")
        if 2 ** (len(steps) - 1) >= n or met.where("further is not null").isEmpty():
            break
        steps.append(written(met.select("repo_id", "node", F.coalesce("further", "at").alias("at"), F.least("least", "least_there").alias("least"))))
    roots = written(met.select("repo_id", "node", F.coalesce("least_there", "at").alias("root")).where("node <> root"))
    rest = edges.join(roots.select("repo_id", F.col("node").alias(b)), ["repo_id", b], "left_anti").join(roots.select("repo_id", F.col("node").alias(a), "root"), ["repo_id", a], "left")
    rest = written(rest.select("repo_id", F.col(a).alias("node"), F.coalesce("root", a).alias("root"), F.col(b).alias("other")))
    return written(rest.select("repo_id", F.col("root").alias(a), F.col("other").alias(b)).where("src <> dst").distinct().select("repo_id", "src", "dst")), (steps, roots, rest)


def _unfolded(found: DataFrame, steps: list[DataFrame], roots: DataFrame, rest: DataFrame) -> DataFrame:
    """found (repo_id, node, component) of the folded graph: that of the graph before. A folded node is in its root's component if an edge to that component leaves it or a node folded through it."""
    known = lambda c: found.select("repo_id", F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
    own = F.coalesce("of_root", "root")
    on = written(rest.join(known("root"), ["repo_id", "root"], "left").join(known("other"), ["repo_id", "other"], "left").where(own == F.coalesce("of_other", "other")).select("repo_id", "node").distinct())
    if on.isEmpty():
        return found
    for step in steps:
        on = written(on.unionByName(on.join(step, ["repo_id", "node"]).select("repo_id", F.col("at").alias("node"))).distinct())
    back = on.join(roots, ["repo_id", "node"]).join(known("root"), ["repo_id", "root"], "left").select("repo_id", F.explode(F.array("node", "root")).alias("node"), own.alias("component"))
    return written(found.unionByName(back).distinct())


def _spread(values: DataFrame, edges: DataFrame) -> DataFrame:
    """values (repo_id, node, value), edges (repo_id, a, b): each node's least value among those of all nodes that reach it; nulls are no values."""
    now = written(values)
    while True:
        sent = edges.join(now.select("repo_id", F.col("node").alias("a"), "value").where("value is not null"), ["repo_id", "a"]).select("repo_id", F.col("b").alias("node"), "value")
        new = written(now.select("repo_id", "node", "value").unionByName(sent).groupBy("repo_id", "node").agg(F.min("value").alias("value")))
        if new.join(now.select("repo_id", "node", F.col("value").alias("old")), ["repo_id", "node"]).where(~F.col("value").eqNullSafe(F.col("old"))).isEmpty():
            return new
        now = new
