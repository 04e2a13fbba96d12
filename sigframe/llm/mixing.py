"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). A flow routes
each pattern's words to the quotas of its sources; the k-th pass over a pattern costs more than the
one before, so repetition is spread evenly and used only where quotas need it. The flow gives words
per pattern and source; documents are then chosen in the order of a seeded hash.

Targets: sources in code-point order, null last, weigh 5, 2, 1, repeating, and share all words; a
target stops at 3 times its source's size and the excess is shared anew by weight among the rest.

Choosing: of a pattern with quota q and size S every document is taken floor(q / S) times; for the
rest, documents are taken once more in hash order while they fit, and last the one untaken document
whose size comes closest to what is missing, if that brings the sum nearer. Documents are whole.
The order is summed per hash bucket, then inside the one bucket that holds the boundary, so no task
sorts a whole source. What decides is a few numbers per pattern, so rows are marked where they are
read, without a join of rows. The driver holds one row per pattern: patterns are bounded by
`MAX_PATTERNS`, beyond which the mix is refused with an error.

Flow: only the passes over a pattern cost anything and a path takes one of them, so the cheapest flow is
found by cost: blocking flows over shortest paths for the first pass, then for the second, then the third.

Cases: a document without words is taken 0; one in no source (an empty or null list) has target and
source_size 0 and is taken 0; the sources of a document count once each; equal rows are separate
documents, of which as many are taken as fit; an empty table gives no rows; columns of other names
are carried along by `taken` and ignored by `mix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigframe.llm.common import Cuts

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Relative cost of a word's first, second, third pass.
PASS_COST = (0, 1, 4)
#: Leading bits of the hash that make a bucket.
BUCKET_BITS = 12
#: Patterns that the driver's flow takes; plans of more rows than the second number are joined, not broadcast.
MAX_PATTERNS, BROADCAST_ROWS = 1_000_000, 20_000


def word_count(text: str) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a column, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets_of(sizes: dict[str | None, int], weights: tuple = WEIGHTS, most: int = MAX_REPEATS) -> dict[str | None, float]:
    """Words due per source. Sources stop in the order of their size by weight, as a rising level would meet them."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, shared, full = float(sum(sizes.values())), sum(weight.values()), {}
    for s in sorted(order, key=lambda s: sizes[s] / weight[s]):
        if left * weight[s] / shared <= most * sizes[s]:
            break
        full[s] = float(most * sizes[s])
        left, shared = left - full[s], shared - weight[s]
    return {s: full[s] if s in full else left * weight[s] / shared for s in order}


class Flow:
    """A flow from patterns to their sources; edges between them are unbounded."""

    def __init__(self, edges: list[list[int]], quotas: list[int]):
        self.edges, self.quota = edges, list(quotas)
        self.supply = [0] * len(edges)
        self.flow: list[dict[int, int]] = [{} for _ in edges]
        self.givers: list[set[int]] = [set() for _ in quotas]  # patterns that give to a source

    def _depths(self) -> tuple[list[int], list[int], bool]:
        """Steps from the patterns that have words left; whether a source with room is reached."""
        p_at, s_at = [-1] * len(self.edges), [-1] * len(self.quota)
        now, depth = [p for p, n in enumerate(self.supply) if n], 0
        for p in now:
            p_at[p] = 0
        while now:
            reached = []
            for p in now:
                for s in self.edges[p]:
                    if s_at[s] < 0:
                        s_at[s] = depth + 1
                        reached.append(s)
            if any(self.quota[s] for s in reached):
                return p_at, s_at, True
            now, depth = [], depth + 2
            for s in reached:
                for p in self.givers[s]:
                    if p_at[p] < 0:
                        p_at[p] = depth
                        now.append(p)
        return p_at, s_at, False

    def run(self) -> None:
        """Blocking flows over shortest paths until none is left."""
        while True:
            p_at, s_at, more = self._depths()
            if not more:
                return
            next_s = [0] * len(self.edges)
            next_p: dict[int, list[int]] = {}
            for start in range(len(self.supply)):
                while self.supply[start] and (path := self._path(start, p_at, s_at, next_s, next_p)):
                    words = min(self.supply[start], self.quota[path[-1]], *(self.flow[path[k + 1]][path[k]] for k in range(1, len(path) - 1, 2)))
                    self.supply[start] -= words
                    self.quota[path[-1]] -= words
                    for k in range(0, len(path), 2):
                        p, s = path[k], path[k + 1]
                        self.flow[p][s] = self.flow[p].get(s, 0) + words
                        self.givers[s].add(p)
                    for k in range(1, len(path) - 1, 2):
                        s, p = path[k], path[k + 1]
                        self.flow[p][s] -= words
                        if not self.flow[p][s]:
                            self.givers[s].discard(p)

    def _path(self, start: int, p_at: list, s_at: list, next_s: list, next_p: dict) -> list[int] | None:
        """pattern, source, pattern, ..., source with room, one step deeper each; dead ends aren't tried again."""
        path = [start]
        while path:
            at = path[-1]
            if len(path) % 2:  # a pattern
                if next_s[at] == len(self.edges[at]):
                    path.pop()
                    if path:
                        next_p[path[-1]].pop()
                    continue
                s = self.edges[at][next_s[at]]
                if s_at[s] == p_at[at] + 1 and (self.quota[s] or next_p.setdefault(s, [p for p in self.givers[s] if p_at[p] == s_at[s] + 1])):
                    path.append(s)
                else:
                    next_s[at] += 1
            elif self.quota[at]:
                return path
            else:
                while next_p[at] and not self.flow[next_p[at][-1]].get(at):
                    next_p[at].pop()
                if next_p[at]:
                    path.append(next_p[at][-1])
                else:
                    path.pop()
                    next_s[path[-1]] += 1
        return None


def route(patterns: dict[tuple, int], targets: dict[str | None, float], most: int = MAX_REPEATS) -> dict[tuple, dict]:
    """Words that each pattern gives each of its sources, at the least cost (`PASS_COST` rises)."""
    order, names = list(patterns), list(targets)
    number = {s: k for k, s in enumerate(names)}
    flow = Flow([[number[s] for s in p] for p in order], [round(targets[s]) for s in names])
    for _ in range(most):
        flow.supply = [n + patterns[p] for n, p in zip(flow.supply, order, strict=True)]
        flow.run()
    return {p: {s: flow.flow[k].get(number[s], 0) for s in p} for k, p in enumerate(order)}


def _plan(rows: DataFrame, weights: tuple, most: int) -> list[dict]:
    """What decides for the rows (sources, size, h) of each pattern; see `taken`."""
    got = rows.groupBy("sources").agg(F.sum("size").alias("words")).limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r["sources"]): int(r["words"]) for r in sorted(got, key=lambda r: [(s is None, s or "") for s in r["sources"]])}
    sizes: dict[str | None, int] = {}
    for p, words in patterns.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    # words held by several sources count once in the total that is shared out
    total = sum(w for p, w in patterns.items() if p)
    scale = total / sum(sizes.values()) if sizes and sum(sizes.values()) else 1.0
    targets = targets_of(sizes, weights, most)
    if scale < 1:
        targets = {s: t * scale for s, t in targets.items()}
    routed = route({p: w for p, w in patterns.items() if p and w}, targets, most)
    plan = []
    for p, words in patterns.items():
        quota = sum(routed.get(p, {}).values())
        full = min(most, quota // words) if words else 0
        plan.append({"pattern": list(p), "source_size": sum(sizes[s] for s in p), "target": float(sum(targets[s] for s in p)), "full": int(full), "rest": int(quota - full * words)})
    return plan


_PLAN = "pattern array<string>, source_size long, target double, full long, rest long, edge int, last_h long, cross_h long, cross_n long, fill_h long, fill_of long"


def _with_plan(rows: DataFrame, plan: list[dict]) -> DataFrame:
    names = [f.split()[0] for f in _PLAN.split(", ")]
    small = rows.sparkSession.createDataFrame([tuple(x.get(n) for n in names) for x in plan], _PLAN)
    return rows.join(F.broadcast(small) if len(plan) <= BROADCAST_ROWS else small, F.col("sources") == F.col("pattern")).drop("pattern")


def _boundary(rows: DataFrame, plan: list[dict]) -> list[dict]:
    """The plan with where the rest of each quota ends in the order of the hashes.

    edge: the bucket; last_h: the last hash taken whole; cross_h, cross_n: the next one, of whose equal
    rows so many are taken; fill_h, fill_of: the hash of one more row, and of how many equal ones.
    """
    by = {tuple(x["pattern"]): x for x in plan}
    left = lambda: _with_plan(rows, [x for x in plan if x["rest"] > 0]).where("size > 0").withColumn("bucket", _bucket())
    sums = left().groupBy("sources", "bucket", "rest").agg(F.sum("size").alias("words"))
    below = F.sum("words").over(Window.partitionBy("sources").orderBy("bucket")) - F.col("words")
    edges = sums.withColumn("below", below).where("below <= rest AND below + words > rest").groupBy("sources").agg(F.min(F.struct("bucket", "below")).alias("x"))
    for r in edges.collect():  # a row per pattern, here and below
        by[tuple(r["sources"])].update(edge=r["x"]["bucket"], below=int(r["x"]["below"]))
    inside = left().where("bucket = edge").groupBy("sources", "h", "rest").agg(F.sum("size").alias("words"), F.max("size").alias("size"), F.count("*").alias("n"))
    start = rows.sparkSession.createDataFrame([(x["pattern"], x["below"]) for x in plan if "below" in x], "pattern array<string>, below long")
    upto = F.col("below") + F.sum("words").over(Window.partitionBy("sources").orderBy("h"))
    inside = inside.join(F.broadcast(start) if len(plan) <= BROADCAST_ROWS else start, F.col("sources") == F.col("pattern")).withColumn("upto", upto)
    last = F.max(F.when(F.col("upto") <= F.col("rest"), F.struct("upto", "h"))).alias("last")
    cross = F.min(F.when(F.col("upto") > F.col("rest"), F.struct("upto", "h", "words", "size", "n"))).alias("cross")
    for r in inside.groupBy("sources").agg(last, cross).collect():
        x, c = by[tuple(r["sources"])], r["cross"]
        x["reached"] = int(r["last"]["upto"]) if r["last"] else x["below"]
        x["last_h"] = r["last"]["h"] if r["last"] else None
        x["cross_h"], x["cross_n"] = (c["h"], (x["rest"] - x["reached"]) // c["size"]) if c else (None, 0)
        x["reached"] += x["cross_n"] * (c["size"] if c else 0)
    gaps = rows.sparkSession.createDataFrame([(x["pattern"], x["rest"] - x["reached"]) for x in plan if "reached" in x], "pattern array<string>, gap long")
    open_ = left().where(~_before()).join(F.broadcast(gaps) if len(plan) <= BROADCAST_ROWS else gaps, F.col("sources") == F.col("pattern"))
    near = open_.withColumn("off", F.abs(F.col("size") - F.col("gap"))).where("off < gap").groupBy("sources", "off", "h").agg(F.count("*").alias("n"))
    for r in near.groupBy("sources").agg(F.min(F.struct("off", "h", "n")).alias("x")).collect():
        by[tuple(r["sources"])].update(fill_h=r["x"]["h"], fill_of=r["x"]["n"])
    return plan


def _bucket() -> Column:
    return F.shiftrightunsigned("h", 64 - BUCKET_BITS).cast("int")


def _before() -> Column:
    """Whether a row comes before the boundary."""
    return F.coalesce((F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & (F.col("h") <= F.col("last_h"))), F.lit(False))


def taken(docs: DataFrame, identity: list[str], weights: tuple = WEIGHTS, most: int = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """`docs` (size, sources array<string>, ...) with source_size, target, and times: how often each is taken.

    identity: the columns that tell rows apart; rows equal in them may stand for each other. They are
    hashed, and each row's hash is held against its pattern's plan, in one pass over `docs`.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "mixing")
    member = F.array_sort(F.array_distinct(F.coalesce("sources", F.array().cast("array<string>"))))
    keyed = docs.withColumns({"size": F.col("size").cast("long"), "sources": member, "h": F.xxhash64(F.lit(seed), *identity)})
    rows = cuts.write(keyed.select("sources", F.coalesce("size", F.lit(0)).alias("size"), "h"))
    plan = _boundary(rows, _plan(rows, weights, most))
    cuts.drop(rows)
    marked = _with_plan(keyed, plan).withColumn("bucket", _bucket())
    partly = F.when(F.col("h") == F.col("cross_h"), F.col("cross_n")).otherwise(0) + F.when(F.col("h") == F.col("fill_h"), 1).otherwise(0)
    here = (F.col("rest") > 0) & (F.col("size") > 0)
    shared = F.coalesce(here & (((F.col("h") == F.col("cross_h")) & (F.col("cross_n") > 0)) | ((F.col("h") == F.col("fill_h")) & (F.col("fill_of") > 1))), F.lit(False))
    more = F.when(~here, 0).when(_before(), 1).when(F.col("h") == F.col("fill_h"), 1).otherwise(0)
    extra = ["source_size", "target"]
    times = lambda x: F.when(F.col("size") > 0, F.col("full") + x).otherwise(0).cast("int").alias("times")
    if not any(x.get("cross_n") or (x.get("fill_of") or 1) > 1 for x in plan):
        return marked.select(*docs.columns, *extra, times(more))
    # the boundary cuts through equal rows: they are counted and written out again, as many as are taken
    groups = marked.where(shared).withColumn("more", partly).groupBy(*docs.columns, *extra, "full", "more").agg(F.count("*").alias("n"))
    split = groups.withColumn("k", F.explode(F.sequence(F.lit(1), "n"))).select(*docs.columns, *extra, times((F.col("k") <= F.col("more")).cast("int")))
    return marked.where(~shared).select(*docs.columns, *extra, times(more)).union(split)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_REPEATS, seed: int = 7) -> DataFrame:
    """Of doc_id, size, sources array<string>: every document with what the mix takes of it.

    doc_id, size, sources, source_size and target (those of its sources together), taken long (words,
    repeats counted), times int (how often the document is taken).
    """
    out = taken(docs.select("doc_id", F.coalesce("size", F.lit(0)).alias("size"), "sources"), ["doc_id", "size"], weights, most, seed)
    return out.select("doc_id", "size", "sources", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"), "times")
