"""Commits, trees and time travel.

commits(commit_hash, commit_type, created_at, tree_hash), parents(commit_hash, parent,
ord), entries(commit_hash, path, raw_hash, ...). A store's graph is bounded, so that it
is walked whole in one task, and a larger one by contraction; recursive SQL would multiply rows at
diamonds and stops at a depth of 100. Trees are unbounded and stay in joins.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import canonical_hash, content_hash
from ..sources.stores import discard, written

#: Commits that a walk may reach.
MOST_COMMITS = 100_000
#: Edges of a contracted graph that a task walks, and edges that a commit's going may add before contraction is given up.
SKELETON, MOST_ADDED = 2 * MOST_COMMITS, 1024
#: Edges of numbered commits that a task contracts by itself, on an average and at most; and edges times ends of a block that it walks.
BLOCK, MOST_IN_BLOCK, MOST_WALKED = 1 << 17, 1 << 20, 1 << 24


def reachable(starts: DataFrame, parents: DataFrame, *, first_parent: bool = False, by: list[str] | None = None, most: int = MOST_COMMITS) -> DataFrame:
    """(*by, start, commit_hash, depth): every commit that each start reaches, itself at depth 0, at its least depth.

    The graph of one store (named by the columns ``by``) has ``most`` commits at most,
    or the query fails; within that bound one task walks it, and stores run side by side. A single graph
    (no ``by``) of more parents than MOST_COMMITS is walked by contraction instead.
    """
    keys = by or []
    if not keys and most == MOST_COMMITS and parents.limit(MOST_COMMITS + 1).count() > MOST_COMMITS:
        return reachable_by_contraction(starts, parents, first_parent=first_parent)
    edges = (parents.where("ord = 0") if first_parent else parents).select(*keys, "commit_hash", "parent")
    kinds = "".join(f"{k} {dict(starts.dtypes)[k]}, " for k in keys)

    def walk(key: tuple, s: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        if e["commit_hash"].nunique() > most:
            raise ValueError(f"a graph has more than {most} commits")
        up: dict[str, list[str]] = {}
        for child, parent in zip(e["commit_hash"], e["parent"], strict=True):
            up.setdefault(child, []).append(parent)
        out: list[tuple] = []
        for start in dict.fromkeys(s["commit_hash"]):
            seen, frontier, depth = {start}, [start], 0
            while frontier:
                out += [(*key[: len(keys)], start, c, depth) for c in frontier]
                frontier = [p for p in dict.fromkeys(p for c in frontier for p in up.get(c, ())) if p not in seen]
                seen.update(frontier)
                depth += 1
        return pd.DataFrame(out, columns=[*keys, "start", "commit_hash", "depth"])

    one = lambda df: df.groupBy(*(keys or [F.lit(0).alias("_all")]))
    return one(starts.select(*keys, "commit_hash")).cogroup(one(edges)).applyInPandas(walk, f"{kinds}start string, commit_hash string, depth int")


def reachable_by_contraction(starts: DataFrame, parents: DataFrame, *, first_parent: bool = False, by: list[str] | None = None, most: int | None = None, numbered: bool = False) -> DataFrame:
    """``reachable`` for graphs of any size, by joins over tables that shrink.

    Each round takes commits out of the graph, no two of them neighbours, and joins their children to their
    parents by edges of as many steps; only commits whose going adds no edges are taken, and where few of them are left, those that
    add few. When SKELETON edges of a store are left, one task a start walks them; rounds are then undone, last first: a commit's depth is
    the least of its children's in its round, and their steps. A graph too dense to shrink is walked edge by edge from what is left. Starts stay
    to the end. More than ``most`` reached commits are an error.

    Where commits are ``numbered`` (whole numbers, near each other for most neighbours), blocks of numbers are contracted
    first, each in a task, until SKELETON edges are left or most edges lead from block to block; every block keeps the
    commits that others lead to, and is filled in from them in the end.
    """
    keys = by or []
    edges = (parents.where("ord = 0") if first_parent else parents).where("parent is not null and commit_hash <> parent")
    left = edges.select(*keys, F.col("commit_hash").alias("child"), "parent", F.lit(1).alias("steps"))
    left = written(left if numbered else left.distinct())  # blocks see to equal edges themselves
    first = written(starts.select(*keys, F.col("commit_hash").alias("start")).distinct())
    largest = lambda df: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    rounds: list[DataFrame] = []
    n, slack = largest(left), 0
    levels: list[tuple[DataFrame, int, int]] = []
    while numbered and n > SKELETON:
        low, high = left.agg(F.min("child"), F.max("child")).first()
        width = min(max(1, (high - low + 1) * BLOCK // n), (1 << 63) - 1)
        blocks = _blocks(left, first, keys, width)
        rows, across, most_rows = blocks.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("inner")).alias("across")).agg(F.sum("n"), F.sum("across"), F.max("n")).first()
        if most_rows > MOST_IN_BLOCK or across > 0.5 * rows:
            break
        levels.append((left, width, rows // BLOCK + 1))
        left, before = written(_contracted(blocks, keys, rows // BLOCK + 1)), n
        n = largest(left)
        if n > 0.5 * before:
            break
    while n > SKELETON and slack <= MOST_ADDED:
        name = lambda c: F.xxhash64(c, F.lit(len(rounds)))  # noqa: B023, E731  a new order each round
        up = left.select(*keys, F.col("child").alias("commit"), F.lit(0).alias("ins"), F.lit(1).alias("outs"), name("parent").alias("other"))
        down = left.select(*keys, F.col("parent").alias("commit"), F.lit(1).alias("ins"), F.lit(0).alias("outs"), name("child").alias("other"))
        stay = first.select(*keys, F.col("start").alias("commit"), F.lit(0).alias("ins"), F.lit(0).alias("outs"), F.lit(-(1 << 63)).alias("other"))
        ends = up.unionByName(down).unionByName(stay).groupBy(*keys, "commit").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), F.min("other").alias("other"))
        taken = written(ends.where((name("commit") < F.col("other")) & (F.col("ins") * F.col("outs") <= F.col("ins") + F.col("outs") + slack)).select(*keys, "commit"))
        into = taken.select(*keys, F.col("commit").alias("parent"), F.lit(True).alias("into"))
        out_of = taken.select(*keys, F.col("commit").alias("child"), F.lit(True).alias("out_of"))
        marked = written(left.join(into, [*keys, "parent"], "left").join(out_of, [*keys, "child"], "left"))
        way = marked.where("into").select(*keys, "child", F.col("parent").alias("via"), F.col("steps").alias("_steps"))
        on = marked.where("out_of").select(*keys, F.col("child").alias("via"), "parent", "steps")
        added = way.join(on, [*keys, "via"]).where("child <> parent").select(*keys, "child", "parent", (F.col("steps") + F.col("_steps")).alias("steps"))
        rest = marked.where("into is null and out_of is null").select(*keys, "child", "parent", "steps")
        after = written(rest.unionByName(added).groupBy(*keys, "child", "parent").agg(F.min("steps").alias("steps")))
        discard(taken, *([] if levels and left is levels[-1][0] else [left]))
        rounds.append(marked)
        left, before, n = after, n, largest(after)
        if n > 0.9 * before:
            slack = max(1, 2 * slack)
    found = [written(_walked(first, left, keys) if n <= SKELETON else _relaxed(first, left, keys))]
    total = found[0].count()
    for marked in reversed(rounds):
        if most is not None and total > most:
            break
        step = marked.where("into").select(*keys, F.col("child").alias("commit_hash"), F.col("parent").alias("to"), "steps")
        seen = functools.reduce(DataFrame.unionByName, found)
        more = seen.join(step, [*keys, "commit_hash"]).groupBy(*keys, "start", F.col("to").alias("commit_hash")).agg(F.min(F.col("depth") + F.col("steps")).alias("depth"))
        found.append(written(more))
        total += found[-1].count()
    for edges, width, tasks in reversed(levels):
        if most is not None and total > most:
            break
        found.append(written(_filled(functools.reduce(DataFrame.unionByName, found), edges, keys, width, tasks)))
        total += found[-1].count()
    discard(left, first, *rounds, *(level[0] for level in levels))
    if most is not None and total > most:
        raise ValueError(f"a walk reaches more than {most} commits")
    return functools.reduce(DataFrame.unionByName, found)


reachable_by_doubling = reachable_by_contraction  # its name when it squared the graph


def _block(c: str, width: int):
    return F.expr(f"{c} div {width}L")


def _blocks(edges: DataFrame, first: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(*keys, block, child, parent, steps, inner): edges by the block of their child, and, without a parent, a block's commits that stay: starts and those that other blocks lead to."""
    own = edges.select(*keys, _block("child", width).alias("block"), "child", "parent", "steps", (_block("child", width) == _block("parent", width)).alias("inner"))
    ends = own.where(~F.col("inner")).select(*keys, "parent").unionByName(first.select(*keys, F.col("start").alias("parent"))).distinct()
    return own.unionByName(ends.select(*keys, _block("parent", width).alias("block"), F.col("parent").alias("child")), allowMissingColumns=True)


def _contracted(blocks: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """(*keys, child, parent, steps): the shortest ways between commits that stay, by as few edges as are found in a block.

    Commits go whose going adds no edges; where all ways from end to end are surely fewer than the edges that are left, those stand instead.
    """

    def contract(key: tuple, g: pa.Table) -> pa.Table:
        e = g.filter(pc.is_valid(g.column("parent")))
        stay = set(g.filter(pc.is_null(g.column("parent"))).column("child").to_pylist())
        outside = set(e.filter(pc.invert(e.column("inner"))).column("parent").to_pylist())
        kept = stay | outside
        up, _, _ = _without_links(e, kept)
        down: dict[int, set[int]] = {}
        for c, ways in up.items():
            for p in ways:
                down.setdefault(p, set()).add(c)
        inner = (up.keys() | down.keys()) - kept
        ahead = list(inner)
        while ahead:
            c = ahead.pop()
            ins, outs = down.get(c, ()), up.get(c, {})
            if c not in inner or len(ins) * len(outs) > len(ins) + len(outs):
                continue
            inner.discard(c)
            for p in outs:
                down[p].discard(c)
            for child in ins:
                ways = up[child]
                steps = ways.pop(c)
                for p, more in outs.items():
                    known = ways.get(p)
                    if known is None and p != child:
                        ways[p] = steps + more
                        down[p].add(child)
                    else:  # both have a neighbour less now
                        if p != child and steps + more < known:
                            ways[p] = steps + more
                        ahead += (p, child)
            if not ins or not outs:
                ahead += (*ins, *outs)
            up.pop(c, None)
            down.pop(c, None)
        n = sum(map(len, up.values()))
        if len(stay) * (len(stay) + len(outside)) < n <= MOST_WALKED // max(1, len(stay)):
            up = {c: {p: d for p, d in _depths({c: 0}, up, kept - {c}).items() if p in kept and p != c} for c in stay}
        edges = [(c, p, steps) for c, ways in up.items() for p, steps in ways.items()]
        columns = [[e[i] for e in edges] for i in range(3)]
        return pa.table([*(pa.repeat(k, len(edges)) for k in key[:-1]), *(pa.array(v, g.schema.field(c).type) for c, v in zip(("child", "parent", "steps"), columns, strict=True))], [*keys, "child", "parent", "steps"])

    kinds = dict(blocks.dtypes)
    return blocks.repartition(tasks, *keys, "block").groupBy(*keys, "block").applyInArrow(contract, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "child", "parent", "steps"]))


def _filled(found: DataFrame, edges: DataFrame, keys: list[str], width: int, tasks: int) -> DataFrame:
    """(*keys, start, commit_hash, depth) of the commits that blocks of ``edges`` gave up, from those ``found``, which all ways into a block lead by."""
    at = found.select(*keys, "start", _block("commit_hash", width).alias("block"), "commit_hash", "depth")
    inner = edges.where(_block("child", width) == _block("parent", width)).select(*keys, _block("child", width).alias("block"), "child", "parent", "steps")
    each = [*keys, "start", "block"]

    def fill(key: tuple, e: pa.Table, s: pa.Table) -> pa.Table:
        seeds = dict(zip(s.column("commit_hash").to_pylist(), s.column("depth").to_pylist(), strict=True))
        up, links, (head, steps) = _without_links(e, seeds.keys())
        depth = _depths(seeds, up)
        above = np.array([depth.get(c, -1) for c in head.tolist()], np.int64)
        commits = np.concatenate([links[above >= 0], np.array([c for c in depth if c not in seeds], np.int64)])
        depths = np.concatenate([(above + steps)[above >= 0], np.array([d for c, d in depth.items() if c not in seeds], np.int64)])
        return pa.table([*(pa.repeat(k, len(commits)) for k in key[:-1]), pa.array(commits, s.schema.field("commit_hash").type), pa.array(depths, pa.int32())], [*keys, "start", "commit_hash", "depth"])

    # as many pairs of a start and a block as there are blocks of rows in the result
    pairs = at.select(*[F.col(c).alias(f"_{c}") for c in each]).distinct()
    same = functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in [*keys, "block"]])
    starts = inner.join(F.broadcast(pairs), same).select(*keys, F.col("_start").alias("start"), "block", "child", "parent", "steps")
    kinds = dict(at.dtypes)
    dealt = lambda df: df.repartition(tasks, *each).groupBy(*each)
    return dealt(starts).cogroup(dealt(at)).applyInArrow(fill, ", ".join(f"{c} {kinds[c]}" for c in [*keys, "start", "commit_hash", "depth"]))


def _without_links(edges: pa.Table, kept) -> tuple[dict, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """``_ways`` of numbered commits without the links of chains, which have one child and one parent and are not ``kept``; the links; and the commit that each one's chain comes from, with the steps from it."""
    c, p, steps = (edges.column(k).to_numpy().astype(np.int64) for k in ("child", "parent", "steps"))
    ids, at = np.unique(np.concatenate([c, p]), return_inverse=True)
    c, p = at[: len(c)], at[len(c) :]
    link = (np.bincount(c, minlength=len(ids)) == 1) & (np.bincount(p, minlength=len(ids)) == 1) & ~np.isin(ids, np.fromiter(kept, np.int64, len(kept)))

    def ends(of: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        to, far, on = np.arange(len(ids)), np.zeros(len(ids), np.int64), link[of]
        to[of[on]], far[of[on]] = other[on], steps[on]
        for _ in range(len(ids).bit_length() + 1):  # a ring of links has no end
            if not link[to].any():
                break
            far, to = far + far[to], to[to]
        return to, far

    to, far = ends(c, p)
    rest = ~link[c] & (to[p] != c)
    up = _ways(pa.table({"child": ids[c[rest]], "parent": ids[to[p[rest]]], "steps": steps[rest] + far[p[rest]]}))
    head, far = ends(p, c)
    whole = link & ~link[head]
    return up, ids[whole], (ids[head[whole]], far[whole])


def _ways(edges: pa.Table) -> dict:
    """The parents of each child with the steps to them."""
    up: dict = {}
    for child, parent, steps in zip(*(edges.column(c).to_pylist() for c in ("child", "parent", "steps")), strict=True):
        ways = up.setdefault(child, {})
        if steps < ways.get(parent, 1 << 62):
            ways[parent] = steps
    return up


def _depths(seeds: dict, up: dict, stop: set | frozenset = frozenset()) -> dict:
    """Least depths of what ``seeds`` (commits with depths) reach, without going on from commits in ``stop``."""
    depth, done = dict(seeds), set()
    ahead = [(d, c) for c, d in seeds.items()]
    heapq.heapify(ahead)
    while ahead:
        d, c = heapq.heappop(ahead)
        if c not in done:
            done.add(c)
            if c in stop:
                continue
            for p, steps in up.get(c, {}).items():
                if d + steps < depth.get(p, 1 << 62):
                    depth[p] = d + steps
                    heapq.heappush(ahead, (d + steps, p))
    return depth


def _walked(first: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, start, commit_hash, depth) by the shortest ways over few edges (child, parent, steps), each start in a task."""

    def walk(key: tuple, g: pa.Table) -> pa.Table:
        start = key[-1].as_py()
        depth = _depths({start: 0}, _ways(g))
        del depth[start]
        names, kinds = [*keys, "start"], [*(k.type for k in key), g.schema.field("parent").type, pa.int32()]
        return pa.table([*(pa.repeat(k, len(depth)) for k in key), pa.array(list(depth), kinds[-2]), pa.array(list(depth.values()), kinds[-1])], [*names, "commit_hash", "depth"])

    kinds = dict(first.dtypes)
    each = edges.join(first, keys) if keys else edges.crossJoin(first)
    reached = each.groupBy(*keys, "start").applyInArrow(walk, "".join(f"{k} {kinds[k]}, " for k in [*keys, "start"]) + f"commit_hash {dict(edges.dtypes)['parent']}, depth int")
    return first.select(*keys, "start", F.col("start").alias("commit_hash"), F.lit(0).alias("depth")).unionByName(reached)


def _relaxed(first: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """As ``_walked`` over any number of edges, as many rounds as the shortest ways have edges."""
    seen, state = written(first.select(*keys, "start", F.col("start").alias("commit_hash"), F.lit(0).alias("depth"))), None
    step = edges.select(*keys, F.col("child").alias("commit_hash"), F.col("parent").alias("to"), "steps")
    while True:
        more = seen.join(step, [*keys, "commit_hash"]).select(*keys, "start", F.col("to").alias("commit_hash"), (F.col("depth") + F.col("steps")).alias("depth"))
        then = written(seen.unionByName(more).groupBy(*keys, "start", "commit_hash").agg(F.min("depth").alias("depth")))
        discard(seen)
        now = tuple(then.agg(F.count(F.lit(1)), F.sum("depth")).first())
        seen, before, state = then, state, now
        if state == before:
            return seen


def within_limits(reached: DataFrame, entries: DataFrame, *, by: list[str] | None = None, commits: int = MOST_COMMITS, rows: int = 10_000_000, size: int = 4 << 30) -> DataFrame:
    """The entries (commit_hash, size_bytes, ...) of reached commits, if a walk of each store may read so much: commits, entries, and bytes; otherwise an error."""
    key = [*(by or []), "commit_hash"]
    held = entries.join(reached.select(*key).distinct(), key, "left_semi")
    walked = reached.select(*key).distinct().groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"))
    read = held.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("size_bytes").cast("decimal(38,0)")), F.lit(0)).alias("size"))
    worst = read.agg(F.max("n").alias("n"), F.max("size").alias("size")).first()
    for what, found, most in (("commits", walked.agg(F.max("n")).first()[0], commits), ("entries", worst.n, rows), ("bytes", worst.size, size)):
        if found and found > most:
            raise ValueError(f"a walk has {found} {what}; {most} are allowed")
    return held


def present(reached: DataFrame, entries: DataFrame, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entries of reached commits that have a tree, reached commits without one: shallow), stores told apart by ``by``. A shallow start is an error."""
    key = [*(by or []), "commit_hash"]
    shallow = reached.join(entries.select(*key).distinct(), key, "left_anti")
    if not shallow.where("start = commit_hash").isEmpty():
        raise ValueError("the walk starts at a commit without a tree")
    return reached.join(entries, key), shallow


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, old_hash, new_hash and state (added, deleted, modified, unchanged) of two trees (path, raw_hash)."""
    a, b = old.select("path", F.col("raw_hash").alias("old_hash")), new.select("path", F.col("raw_hash").alias("new_hash"))
    state = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").withColumn("state", state)


def commit_stats(changes: DataFrame) -> DataFrame:
    return changes.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("added", "modified", "deleted")])


def smallest_paths(entries: DataFrame, key: list[str]) -> DataFrame:
    """One row per content key with its bytewise smallest path."""
    return entries.groupBy(*key).agg(F.min("path").alias("path"))


def introductions(entries: DataFrame, parents: DataFrame, key: list[str]) -> DataFrame:
    """(commit_hash, *key): commits that hold a binding which none of their present parents holds."""
    held = entries.select("commit_hash", *key).distinct()
    before = parents.select("commit_hash", "parent").join(held.withColumnRenamed("commit_hash", "parent"), "parent").select("commit_hash", *key)
    return held.join(before, ["commit_hash", *key], "left_anti")


def in_order(edges: list[tuple[str, str]]) -> list[str]:
    """The commits of a graph, parents before children."""
    up: dict[str, list[str]] = {}
    for child, parent in edges:
        up.setdefault(child, []).append(parent)
        up.setdefault(parent, [])
    out: dict[str, None] = {}
    for first in up:
        stack = [first]
        while stack:
            c = stack[-1]
            wait = [p for p in up[c] if p not in out] if c not in out else []
            if wait:
                stack += wait
                if len(stack) > 2 * len(up) * (1 + max(map(len, up.values()))):
                    raise ValueError("a commit is its own ancestor")
            else:
                out[stack.pop()] = None
    return list(out)


def canonical_introduction(introduced: DataFrame, parents: DataFrame, key: list[str], most: int = MOST_COMMITS) -> DataFrame:
    """The ancestor-most introduction of each binding, the smallest hash among several.

    Of ``introduced`` (commit_hash, *key) in one store's graph, which has ``most`` commits at most
    and goes to all tasks. A task takes bindings by the thousand: one bit each says for every
    commit, parents first, whether an ancestor introduces the binding.
    """
    edges = [tuple(r) for r in parents.select("commit_hash", "parent").distinct().limit(4 * most + 1).collect()]
    order = in_order(edges)
    if len(order) > most or len(edges) > 4 * most:
        raise ValueError(f"a graph has more than {most} commits")
    up: dict[str, list[str]] = {c: [] for c in order}
    for child, parent in edges:
        up[child].append(parent)
    sent = introduced.sparkSession.sparkContext.broadcast((order, up))
    grouped = introduced.groupBy(*key).agg(F.array_sort(F.collect_set("commit_hash")).alias("commits"))  # no more than there are commits
    single = grouped.where(F.size("commits") == 1).select(*key, F.element_at("commits", 1).alias("commit_hash"))

    def run(batches):
        order, up = sent.value
        for b in batches:
            sets = b.column("commits").to_pylist()
            first = []
            for i in range(0, len(sets), 4096):
                own: dict[str, int] = {}
                for k, commits in enumerate(sets[i : i + 4096]):
                    for c in commits:
                        own[c] = own.get(c, 0) | 1 << k
                above: dict[str, int] = {}
                for c in order:
                    bits = 0
                    for p in up[c]:
                        bits |= above[p] | own.get(p, 0)
                    above[c] = bits
                first += [next(c for c in commits if not above.get(c, 0) >> k & 1) for k, commits in enumerate(sets[i : i + 4096])]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in key), pa.array(first, pa.string())], [*key, "commit_hash"])

    kinds = dict(grouped.dtypes)
    several = grouped.where(F.size("commits") > 1).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in key) + ", commit_hash string")
    return single.unionByName(several)


def final_deleted(chain: DataFrame, entries: DataFrame, head: DataFrame) -> DataFrame:
    """The newest version of every path that the first-parent chain (commit_hash, depth) held and the head does not."""
    held = chain.select("commit_hash", "depth").join(entries, "commit_hash").join(head.select("path").distinct(), "path", "left_anti")
    nth = F.row_number().over(W.partitionBy("path").orderBy("depth"))
    return held.withColumn("nth", nth).where("nth = 1").drop("nth")


def include_deleted(live: DataFrame, deleted: DataFrame, key: list[str]) -> DataFrame:
    """Live rows, and deleted ones whose content key is not live."""
    return live.unionByName(deleted.join(live.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def current_paths(entries: DataFrame) -> DataFrame:
    return entries.groupBy("raw_hash").agg(F.array_sort(F.collect_set("path")).alias("current_paths"))


def visible_at(publications: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Publications that some ancestor-or-equal of the target introduced."""
    return publications.join(ancestors.select(F.col("commit_hash").alias("introduction_commit")), "introduction_commit", "left_semi")


def all_bindings(head: DataFrame, parents: DataFrame, entries: DataFrame, key: list[str]) -> DataFrame:
    """Every distinct binding that the head reaches, its canonical introduction (pointer_commit), and whether the head has it."""
    reached = reachable(head, parents).select("commit_hash").distinct()
    held = entries.join(reached, "commit_hash", "left_semi").select(*key).distinct()
    first = canonical_introduction(introductions(entries, parents, key), parents, key).withColumnRenamed("commit_hash", "pointer_commit")
    live = entries.join(head, "commit_hash", "left_semi").select(*key).distinct().withColumn("_live", F.lit(True))
    return held.join(first, key).join(live, key, "left").withColumn("is_live", F.coalesce("_live", F.lit(False))).drop("_live")


def snapshot(working: DataFrame, entries: DataFrame, head: str | None, *, kind: str = "manual", at: int = 0, message: str = "") -> tuple[dict, DataFrame]:
    """A commit of the tree ``working`` (path, raw_hash) on ``head``: its record with stats, and its entries; an unchanged tree gives, if kind is auto or scheduled, the head and no entries.

    kind is manual, auto, scheduled, purged or repaired. The tree's hash is that of its
    entries' hashes in the order of their paths; the commit's that of its canonical record.
    """
    if kind not in ("manual", "auto", "scheduled", "purged", "repaired"):
        raise ValueError(f"unknown kind of commit: {kind}")
    old = entries.where(F.col("commit_hash") == head).select("path", "raw_hash") if head else working.limit(0)
    stats = commit_stats(diff(old, working)).first().asDict()
    if head and not any(stats.values()) and kind in ("auto", "scheduled"):
        return {"commit_hash": head, "stats": stats}, working.limit(0).withColumn("commit_hash", F.lit(head))
    line = F.sha2(F.concat_ws("\t", "path", "raw_hash"), 256)
    # buckets of lines are hashed first, so that no task holds a whole tree
    part = working.withColumn("_part", F.substring(F.sha2("path", 256), 1, 2)).groupBy("_part").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", F.col("path"), line))), "\n"), 256).alias("h"))
    tree = part.agg(content_hash(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "h"))), lambda x: x["h"]), "\n")).alias("t")).first().t
    record = {"kind": kind, "message": message, "parent": head, "created_at": at, "tree_hash": tree, "stats": stats}
    commit = canonical_hash({k: v for k, v in record.items() if v is not None})
    return record | {"commit_hash": commit}, working.select(F.lit(commit).alias("commit_hash"), "path", "raw_hash")
