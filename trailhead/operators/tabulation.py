"""Tabulation on tables of path edges: one solver for facts that flow forwards or backwards.

A program is a set of relations, so rules are rows and not code:

    edges   method, src, dst                    control flow; node EXIT stands for the end
    flows   method, stmt, base, path, to, to_path   base.path.x before stmt holds as to.to_path.x after it
    kills   method, stmt, base, path            base.path.x before stmt doesn't hold after it
    enters  method, stmt, callee, base, to      base.x at a call holds as to.x at the callee's start
    leaves  callee, method, stmt, base, to, deep    base.x at the callee's end holds as to.x after the call
                                                (deep: only where x has a field)
    starts  method, stmt                        where methods begin
    moves   method, stmt, base, at, by, most, revisit   base.#i moves by that many where i is at or after at

A path edge (method, entry, stmt, base, path) says: if the method is entered with entry,
base.path holds before stmt. In a round each new entry of a method is walked to its end by itself, over
the rules of that one method, so a method that many enter is spread over tasks; what passes
between methods is joined: facts at calls with the callees' starts, and callers with the
summaries of callees from whichever side is new. So the number of rounds follows the depth
of calls. A round's edges are written to the shared folder, and a lost executor costs one
round. Entries are facts without their origin, so a
method is solved once for all sources that enter it alike; which origins stand behind an
entry is found at the end, along the calls. Entries ``0|origin`` are those of facts that
begin in the method itself, and ``back|stmt|base|path`` those of facts that came back from a callee which
no call led into, shared by all origins behind them.

A program read backwards is the converse of every relation (``converse``), so backward
taint is the same solver from the sinks. Sparse control flow (``sparse``) leads each base
from one statement that concerns it to the next, past all others.

Paths are fields joined by dots, at most MAX_FIELDS; a path stands for all that begin with it.
A field #i or #i-j is a place of a list, or one of several, $k a key of a map, and #* and $* are
any (``with_containers``). Rules read places that may meet; they clear a field that is just the same.

A store into a field concerns all names of the object. They are searched on demand
(``with_aliases``): backwards from each store that a fact passes, then forwards from where
another name was found to the store again, which is the statement that makes the fact true
under the other name. Names given after the store come by ordinary copies; loads of the field
before it see the old value.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.operators import frontend, hierarchy, recursion
from trailhead.storage import in_frames, written

MAX_FIELDS = 5
EXIT = -1
FACT = ["method", "entry", "stmt", "base", "path"]
#: Rounds after which the tables of earlier rounds are written as one.
FOLD = 8
#: Rows of a frame that a task gives back at once.
FRAME = 1 << 16
SCHEMAS = {
    "edges": "method string, src long, dst long",
    "flows": "method string, stmt long, base string, path string, to string, to_path string",
    "kills": "method string, stmt long, base string, path string",
    "enters": "method string, stmt long, callee string, base string, to string",
    "leaves": "callee string, method string, stmt long, base string, to string, deep boolean",
    "starts": "method string, stmt long",
    "moves": "method string, stmt long, base string, at int, by int, most int, revisit boolean",
}
#: The upper bound of a place; an interval up to it is open.
TOP = 2**31 - 1
#: Places past it are opened, which ends walks that no revisit ends, such as recursion.
MAX_PLACE = 16


@dataclass(frozen=True)
class Program:
    edges: DataFrame
    flows: DataFrame
    kills: DataFrame
    enters: DataFrame | None = None
    leaves: DataFrame | None = None
    starts: DataFrame | None = None
    moves: DataFrame | None = None

    def written(self) -> Program:
        """Every relation made once, not in every round."""
        return Program(*(None if t is None else written(t.distinct(), name) for name, t in vars(self).items()))


@dataclass(frozen=True)
class Solution:
    """All path edges, and the calls (callee, callee_entry, method, stmt, entry) that were entered.

    Where entries share what was written (``with_globals``), plain has the calls alone, and writes and reads
    (method, entry, hub) say which entries' origins stand behind a hub, and which entries it stands behind.
    """

    facts: DataFrame
    calls: DataFrame | None
    plain: DataFrame | None = None
    writes: DataFrame | None = None
    reads: DataFrame | None = None


def converse(program: Program, ends: DataFrame | None = None) -> Program:
    """The program read backwards: it begins at EXIT, and ends where it began."""
    flows = program.flows.selectExpr("method", "stmt", "to AS base", "to_path AS path", "base AS to", "path AS to_path")
    edges = program.edges.selectExpr("method", "dst AS src", "src AS dst")
    moves = None if program.moves is None else program.moves.withColumn("by", -F.col("by"))
    if program.enters is None:
        return replace(program, edges=edges, flows=flows, moves=moves)
    first = program.starts.selectExpr("method", "stmt AS src", f"{EXIT}L AS dst")
    back = edges.selectExpr("method", f"CASE WHEN src = {EXIT} THEN {EXIT - 1}L ELSE src END AS src", "dst").unionByName(first)
    starts = program.starts.selectExpr("method", f"{EXIT - 1}L AS stmt")
    enters = program.leaves.selectExpr("method", "stmt", "callee", "to AS base", "base AS to")
    leaves = program.enters.selectExpr("callee", "method", "stmt", "to AS base", "base AS to", "false AS deep")
    return Program(back, flows, program.kills, enters, leaves, starts, moves)


def sparse(program: Program, uses: DataFrame) -> DataFrame:
    """(method, base, src, dst): from src to the next statements that concern base, along control flow.

    uses are further statements (method, stmt, base) that must be seen, such as sinks. A method's control
    flow is one row, on which each base is led past the statements that don't concern it in one task.
    """
    concern = [program.flows.select("method", "stmt", "base"), program.kills.select("method", "stmt", "base"), uses.select("method", "stmt", "base")]
    made = [program.flows.selectExpr("method", "to AS base")]
    if program.enters is not None:
        concern += [program.enters.select("method", "stmt", "base")]
        made += [program.leaves.selectExpr("method", "to AS base"), program.enters.selectExpr("callee AS method", "to AS base"), program.leaves.selectExpr("callee AS method", "base")]
    if program.moves is not None:
        concern.append(program.moves.select("method", "stmt", "base"))
    stops, bases = concern[0], concern[0].select("method", "base")
    for c in concern[1:]:
        stops, bases = stops.unionByName(c), bases.unionByName(c.select("method", "base"))
    for m in made:
        bases = bases.unionByName(m)
    rows = _listed(program.edges.distinct(), "edges", "src", "dst").join(bases.groupBy("method").agg(F.collect_set("base").alias("bases")), "method")
    rows = rows.join(_listed(stops.distinct(), "stops", "stmt", "base"), "method", "left")

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                succ, at = {}, {}
                for e in row.edges:
                    succ.setdefault(e["src"], []).append(e["dst"])
                for s in row.stops if row.stops is not None else ():
                    at.setdefault(s["base"], set()).add(s["stmt"])
                for base in row.bases:
                    own = at.get(base, ())
                    for src in succ:
                        seen, stack = set(), [src]
                        while stack:
                            for dst in succ.get(stack.pop(), ()):
                                if dst not in seen:
                                    seen.add(dst)
                                    if dst == EXIT or dst in own:
                                        out.append((row.method, base, src, dst))
                                    else:
                                        stack.append(dst)
                if len(out) >= FRAME:
                    yield pd.DataFrame(out, columns=["method", "base", "src", "dst"])
                    out = []
            yield pd.DataFrame(out, columns=["method", "base", "src", "dst"])

    return written(in_frames(rows, run, "method string, base string, src long, dst long"), "ways")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def rest(path: str, wanted: str) -> str:
    """SQL: what is left of path once wanted is read, null where they differ."""
    return f"CASE WHEN {wanted} = '' THEN {path} WHEN {path} = '' OR {path} = {wanted} THEN '' WHEN startswith({path}, concat({wanted}, '.')) THEN substring({path}, length({wanted}) + 2) END"


def joined(first: str, second: str) -> str:
    """SQL: first.second with as many fields as are kept."""
    return f"substring_index(concat_ws('.', nullif({first}, ''), nullif({second}, '')), '.', {MAX_FIELDS})"


def _interval(field: str) -> tuple[int, int]:
    low, _, high = field[1:].partition("-")
    return (0, TOP) if low == "*" else (int(low), int(high or low))


def _place(low: int, high: int) -> str:
    return "#*" if high == TOP else f"#{low}" if low == high else f"#{low}-{high}"


def _meet(field: str, wanted: str) -> bool:
    """Whether a field may be the wanted one."""
    if field == wanted:
        return True
    if field[:1] == wanted[:1] == "#":
        (a, b), (c, d) = _interval(field), _interval(wanted)
        return a <= d and c <= b
    return field[:1] == wanted[:1] == "$" and "$*" in (field, wanted)


def _read(path: str, wanted: str, exact: bool) -> str | None:
    """What is left of path once wanted is read."""
    if not wanted or path == wanted or path.startswith(f"{wanted}."):
        return path[len(wanted) :].lstrip(".")
    if not path:
        return None if exact else ""
    if "#" in wanted or "$" in wanted:
        got, want = path.split("."), wanted.split(".")
        if len(got) >= len(want) and all(map(_meet, got, want)):
            return ".".join(got[len(want) :])
    return None


def _cleared(path: str, kill: str) -> bool:
    """Whether kill clears path; a kill # or $ clears all places or keys."""
    return not kill or f"{path}.".startswith(f"{kill}.") or kill in ("#", "$") and path[:1] == kill


def moved(field: str, at: int | None, by: int) -> str | None:
    """A place once values were put in or taken out at a place, or at one that isn't known; None if it is the one taken out.

    Read backwards, what was put in was taken out.
    """
    low, high = _interval(field)
    if high == TOP:
        return field
    if by < 0 and low == high == at:
        return None
    surely, maybe = (at, at) if at is not None else (TOP, 0)
    first, last = (surely, maybe) if by > 0 else (maybe + (at is not None), surely + (at is not None))
    return _place(max(low + by, 0) if low >= first else low, max(high + by, 0) if high >= last else high)


def walk(ways: dict, flows: dict, kills: dict, facts, exact: bool = False, moves: dict | None = None) -> set[tuple]:
    """All facts (stmt, base, path) that some lead to along a method's ways, themselves included.

    A path stands for all that begin with it; if exact, for itself, as the name of an object. A move
    (at, by, most, revisit) opens a place that it moves past most, and with revisit one that comes from
    a place which that statement has moved already: so loops end. Which facts do is known after a
    first walk that only most ends; the second one opens theirs.
    """

    def after(fact, again):
        """(base, path, whether it was moved) after the statement of a fact."""
        stmt, base, path = fact
        out = [] if any(_cleared(path, k) for k in kills.get((stmt, base), ())) else [(base, path, False)]
        steps = moves.get((stmt, base)) if moves and out and path[:1] == "#" else None
        if steps:
            place, *fields = path.split(".")
            for at, by, most, revisit in steps:
                place, before = moved(place, at, by), place
                if place is None:
                    break
                if place != before and (_interval(place)[1] > most or revisit and fact in again.get(stmt, ())):
                    place = "#*"
            out = [] if place is None else [(base, ".".join([place, *fields]), place != path.split(".")[0])]
        for wanted, to, to_path in flows.get((stmt, base), ()):
            left = _read(path, wanted, exact)
            if left is not None:
                out.append((to, ".".join(".".join(x for x in (to_path, left) if x).split(".")[:MAX_FIELDS]), False))
        return out

    def closed(start, again=None, links=None, shifted=None):
        seen, stack = set(start), list(set(start))
        while stack:
            fact = stack.pop()
            for base, path, moved_ in after(fact, again or {}):
                for dst in ways.get((fact[0], base), ways.get((fact[0], None), ())):
                    made = (dst, base, path)
                    if links is not None:
                        links.setdefault(fact, []).append(made)
                        if moved_:
                            shifted.setdefault(fact[0], set()).add(made)
                    if made not in seen:
                        seen.add(made)
                        stack.append(made)
        return seen

    if not moves:
        return closed(facts)
    links, shifted, again = {}, {}, {}
    plain = closed(facts, None, links, shifted)
    for stmt, begin in shifted.items():
        seen, stack = set(begin), list(begin)
        while stack:
            for made in links.get(stack.pop(), ()):
                if made not in seen:
                    seen.add(made)
                    stack.append(made)
        again[stmt] = seen
    return closed(facts, again) if again else plain


def _listed(df: DataFrame, name: str, *columns: str) -> DataFrame:
    return df.groupBy("method").agg(F.collect_list(F.struct(*columns)).alias(name))


def _dense(program: Program) -> DataFrame:
    return program.edges.withColumn("base", F.lit(None).cast("string"))


def _rules(program: Program, ways: DataFrame | None = None) -> DataFrame:
    """The rules of each method as one row (method, rules), in the form in which ``walk`` takes them."""
    rules = _listed(_dense(program) if ways is None else ways, "ways", "base", "src", "dst")
    rules = rules.join(_listed(program.flows, "flows", "stmt", "base", "path", "to", "to_path"), "method", "full")
    rules = rules.join(_listed(program.kills, "kills", "stmt", "base", "path"), "method", "full")
    if program.moves is not None:
        rules = rules.join(_listed(program.moves, "moves", "stmt", "base", "at", "by", "most", "revisit"), "method", "full")

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                ways, flows, kills, moves = ({}, {}, {}, {})
                for e in row.ways if row.ways is not None else ():
                    ways.setdefault((e["src"], e["base"]), []).append(e["dst"])
                for f in row.flows if row.flows is not None else ():
                    flows.setdefault((f["stmt"], f["base"]), []).append((f["path"], f["to"], f["to_path"]))
                for k in row.kills if row.kills is not None else ():
                    kills.setdefault((k["stmt"], k["base"]), []).append(k["path"])
                held_moves = getattr(row, "moves", None)
                for m in held_moves if held_moves is not None else ():
                    moves.setdefault((m["stmt"], m["base"]), []).append((m["at"], m["by"], m["most"], m["revisit"]))
                out.append((row.method, pickle.dumps((ways, flows, kills, moves), pickle.HIGHEST_PROTOCOL)))
            yield pd.DataFrame(out, columns=["method", "rules"])

    return written(in_frames(rules, run, "method string, rules binary"), "rules")


def _walked(rules: DataFrame, new: DataFrame, exact: bool = False) -> DataFrame:
    """The path edges that new ones lead to within their methods; each entry of a method is walked by itself."""
    held = new.groupBy("method", "entry").agg(F.collect_list(F.struct("stmt", "base", "path")).alias("facts"))

    def run(frames):
        last, found = None, ({}, {}, {}, {})
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.method != last:
                    last, found = row.method, ({}, {}, {}, {}) if row.rules is None else pickle.loads(row.rules)
                ways, flows, kills, moves = found
                start = [(f["stmt"], f["base"], f["path"]) for f in row.facts]
                out += [(row.method, row.entry, *fact) for fact in walk(ways, flows, kills, start, exact, moves)]
                if len(out) >= FRAME:
                    yield pd.DataFrame(out, columns=FACT)
                    out = []
            yield pd.DataFrame(out, columns=FACT)

    return in_frames(held.join(rules, "method", "left"), run, "method string, entry string, stmt long, base string, path string")


def _along(after: DataFrame, ways: DataFrame) -> DataFrame:
    """From facts after their statement to facts before the next ones."""
    steps = ways.select("method", F.col("src").alias("stmt"), F.col("base").alias("way"), "dst")
    step = after.join(steps, ["method", "stmt"]).where("way IS NULL OR way = base")
    return step.select("method", "entry", F.col("dst").alias("stmt"), "base", "path")


def _returned(calls: DataFrame, at_end: DataFrame, leaves: DataFrame) -> DataFrame:
    """What holds after calls for facts at the callees' ends."""
    result = at_end.selectExpr("method AS callee", "entry AS callee_entry", "base", "path")
    back = calls.join(result, ["callee", "callee_entry"]).join(leaves, ["callee", "method", "stmt", "base"]).where("NOT deep OR path <> ''")
    return back.select("method", "entry", "stmt", F.col("to").alias("base"), "path")


def tabulated(program: Program, seeds: DataFrame | None, unbalanced: bool = False, ways: DataFrame | None = None, known: Solution | None = None, before: DataFrame | None = None, max_rounds: int | None = None, rules: DataFrame | None = None) -> Solution:
    """All path edges from the seeds (FACT columns): facts that hold after their statement; those in before hold before it.

    Without recorded callers a method's end is the end, unless unbalanced: then facts that
    began in it (entries 0 and back) go on after every call of it, with one entry for all that
    come back alike. ways replaces control flow by a sparse one. With known the seeds are added to a
    solution of the same program; rules are its ``_rules``, if they are made already.
    """
    rules, ways = _rules(program, ways) if rules is None else rules, _dense(program) if ways is None else ways
    parts, calls, ends, links, round_ = [], [], [], [], 0
    if known is not None:
        parts, calls, ends = [known.facts], [known.calls] if known.calls is not None else [], [known.facts.where(f"stmt = {EXIT}")]
    new = _union(([] if seeds is None else [_along(seeds, ways)]) + ([] if before is None else [before.select(*FACT)])).distinct()
    while max_rounds is None or round_ < max_rounds:
        round_ += 1
        fresh = _walked(rules, new)
        fresh = written(fresh.join(_union(parts), FACT, "left_anti") if parts else fresh, "facts")
        parts.append(fresh)
        if program.enters is None or fresh.isEmpty():
            break
        at_end = fresh.where(f"stmt = {EXIT}")
        given = fresh.join(program.enters, ["method", "stmt", "base"])
        given = given.select("callee", F.concat_ws("|", "to", "path").alias("callee_entry"), "method", "stmt", "entry", F.col("to").alias("base"), "path").distinct()
        entered = written(given, "calls")
        begun = entered.select(F.col("callee").alias("method"), F.col("callee_entry").alias("entry"), "base", "path").distinct()
        begun = begun.join(program.starts, "method").select(*FACT)
        own = entered.drop("base", "path")
        after = [_returned(own, _union([*ends, at_end]), program.leaves)]
        if calls:
            after.append(_returned(_union(calls), at_end, program.leaves))
        if unbalanced:
            on = came_back(at_end.withColumnRenamed("method", "callee"), program.leaves)
            on = written(on.selectExpr("method", f"{BACK} AS callee_entry", "stmt", "to AS base", "path", "callee", "entry").distinct(), "returns")
            after.append(on.select("method", F.col("callee_entry").alias("entry"), "stmt", "base", "path").distinct())
            links.append(on.select(F.col("method").alias("callee"), "callee_entry", F.col("callee").alias("method"), F.lit(None).cast("long").alias("stmt"), "entry"))
        calls.append(own)
        ends.append(at_end)
        if round_ % FOLD == 0:
            parts, calls = [written(_union(parts), "facts")], [written(_union(calls), "calls")]
            ends = [parts[0].where(f"stmt = {EXIT}")]
        new = _union([_along(_union(after), ways), begun]).distinct().join(_union(parts), FACT, "left_anti")
    return Solution(_union(parts), _union([*calls, *links]) if calls else None)


#: SQL: the entry of facts that came back unbalanced after a call.
BACK = "concat_ws('|', 'back', stmt, to, path)"


def came_back(at_end: DataFrame, leaves: DataFrame) -> DataFrame:
    """Facts (callee, entry, base, path) at ends of callees that no call led into, with the calls after which they go on."""
    own = at_end.where("startswith(entry, '0|') OR startswith(entry, 'back|')").drop("stmt")
    return own.join(leaves, ["callee", "base"]).where("NOT deep OR path <> ''")


def _with_beginning(program: Program) -> Program:
    """The program with a node before the first statement of each method, where names that hold from the outset are found."""
    first = program.starts.selectExpr("method", f"{EXIT - 1}L AS src", "stmt AS dst")
    return replace(program, edges=program.edges.unionByName(first), enters=None)


def _other_names(program: Program, forward: DataFrame, backward: DataFrame, heap: DataFrame) -> DataFrame:
    """Facts after stores under the other names of the object: heap is (method, entry, stmt, base, path), path being what was stored."""
    mark = "\x01"
    key = F.concat_ws(mark, "entry", F.col("stmt").cast("string"), "path").alias("entry")
    ways = _dense(_with_beginning(program))
    back = ways.select("method", "base", F.col("dst").alias("src"), F.col("src").alias("dst"))
    seeds = heap.select("method", key, "stmt", "base", F.lit("").alias("path"))
    found = _walked(backward, _along(seeds, back).distinct(), exact=True)
    there = _walked(forward, _along(found, ways).distinct(), exact=True).withColumn("part", F.split("entry", mark))
    there = there.where(F.col("part")[1].cast("long") == F.col("stmt"))
    return there.select("method", F.col("part")[0].alias("entry"), "stmt", "base", F.expr(joined("path", "part[2]")).alias("path")).distinct()


def with_aliases(program: Program, seeds: DataFrame, unbalanced: bool = False) -> Solution:
    """tabulated(), where a store or a callee that writes to an object's field concerns all names that the object has in the method."""
    forward, backward = _rules(program), _rules(converse(_with_beginning(program)))
    solution = tabulated(program, seeds, unbalanced, rules=forward)
    stores = program.flows.where("to_path <> ''").withColumnRenamed("path", "wanted")
    done = None
    while True:
        stored = solution.facts.join(stores, ["method", "stmt", "base"]).withColumn("rest", F.expr(rest("path", "wanted"))).where("rest IS NOT NULL")
        heap = stored.select("method", "entry", "stmt", F.col("to").alias("base"), F.expr(joined("to_path", "rest")).alias("path"))
        if solution.calls is not None:
            heap = heap.unionByName(_returned(solution.calls, solution.facts.where(f"stmt = {EXIT}"), program.leaves).where("path <> ''"))
        heap = written(heap.distinct() if done is None else heap.distinct().join(done, FACT, "left_anti"), "heap")
        if heap.isEmpty():
            return solution
        done = heap if done is None else done.unionByName(heap)
        more = written(_other_names(program, forward, backward, heap), "aliases")
        solution = tabulated(program, more, unbalanced, known=solution, rules=forward)


def with_globals(program: Program, seeds: DataFrame, unbalanced: bool = False) -> Solution:
    """tabulated(), where a static that any method has written is tainted in every method that reads it, called or not.

    All readers share one entry for each tainted static, whichever methods wrote it; which
    origins stand behind it is found through a method "global" that writers call and readers
    are called by, so their pairs are never made.
    """
    rules = _rules(program)
    solution = tabulated(program, seeds, unbalanced, rules=rules)
    readers = written(program.flows.where("startswith(base, 'static ')").select("method", "stmt", "base").distinct(), "readers")
    key = F.concat_ws("|", F.lit("global"), "base", "path")
    done = begun = None
    while True:
        held = solution.facts.where("startswith(base, 'static ')").select("base", "path").distinct()
        held = written(held if done is None else held.join(done, ["base", "path"], "left_anti"), "globals")
        if held.isEmpty():
            break
        done = held if done is None else done.unionByName(held)
        more = written(readers.join(held, "base").select("method", key.alias("entry"), "stmt", "base", "path"), "globals")
        begun = more if begun is None else begun.unionByName(more)
        solution = tabulated(program, None, unbalanced, known=solution, before=more, rules=rules)
    if begun is None:
        return solution
    none = F.lit(None).cast("long").alias("stmt")
    write = solution.facts.where("startswith(base, 'static ')").select(F.lit("global").alias("callee"), key.alias("callee_entry"), "method", none, "entry")
    read = begun.select(F.col("method").alias("callee"), F.col("entry").alias("callee_entry"), F.lit("global").alias("method"), none, "entry")
    calls = write.unionByName(read).distinct()
    hub = F.col("callee_entry").alias("hub")
    return Solution(solution.facts, calls if solution.calls is None else calls.unionByName(solution.calls), solution.calls, write.select("method", "entry", hub), begun.select("method", "entry", F.col("entry").alias("hub")))


def origins(solution: Solution) -> DataFrame:
    """(method, entry, origin): the origins that stand behind each entry."""
    begun = solution.facts.where("startswith(entry, '0|')").select("method", "entry", F.expr("substring(entry, 3)").alias("origin")).distinct()
    return _carried(solution.calls, begun)


def _carried(calls: DataFrame | None, begun: DataFrame) -> DataFrame:
    """begun (method, entry, origin) carried to all entries that calls lead to."""
    if calls is None:
        return begun
    calls = written(calls.select("callee", "callee_entry", "method", "entry").distinct(), "calls")
    new = written(begun, "origins")
    parts = [new]
    while not new.isEmpty():
        step = calls.join(new, ["method", "entry"]).select(F.col("callee").alias("method"), F.col("callee_entry").alias("entry"), "origin").distinct()
        new = written(step.join(_union(parts), ["method", "entry", "origin"], "left_anti"), "origins")
        parts.append(new)
    return _union(parts)


def reached(solution: Solution, uses: DataFrame) -> DataFrame:
    """(method, stmt, origin, base, path): the uses (method, stmt, base) before which a fact holds, with its origin."""
    at = solution.facts.join(uses.select("method", "stmt", "base").distinct(), ["method", "stmt", "base"])
    if solution.reads is not None:
        return _reached_by_hubs(solution, at)
    return at.join(origins(solution), ["method", "entry"]).select("method", "stmt", "origin", "base", "path").distinct()


def _reached_by_hubs(solution: Solution, at: DataFrame) -> DataFrame:
    """reached() for facts at uses, where all readers of a static have the origins of all its writers.

    A hub is carried along the calls in place of its origins, which are joined to the uses at the end. Pairs of
    a use and an origin, as many as the result has rows, are made once and are not shuffled, but for uses with several hubs.
    """
    mark, use = "\x02", ["method", "stmt", "base", "path"]
    begun = solution.facts.where("startswith(entry, '0|')").select("method", "entry", F.expr("substring(entry, 3)").alias("origin"))
    begun = begun.unionByName(solution.reads.select("method", "entry", F.concat(F.lit(mark), "hub").alias("origin"))).distinct()
    known = written(_carried(solution.plain, begun), "known")
    is_hub = F.startswith("origin", F.lit(mark))
    hub = F.expr("substring(origin, 2)")
    behind = written(solution.writes.join(known, ["method", "entry"]).select("hub", "origin").distinct(), "behind")
    above = recursion.closure(behind.where(is_hub).select(F.col("hub").alias("src"), hub.alias("dst"))).select(F.col("src").alias("hub"), F.col("dst").alias("other"))
    own = behind.where(~is_hub)
    held = written(own.unionByName(above.join(own.withColumnRenamed("hub", "other"), "other").select("hub", "origin")).distinct(), "held")
    found = written(at.join(known, ["method", "entry"]).select(*use, "origin").distinct(), "found")
    hubs = found.where(is_hub).select(*use, hub.alias("hub"))
    direct = found.where(~is_hub)
    again = direct.join(hubs, use).join(held, ["hub", "origin"], "left_semi").select(*use, "origin").distinct()
    grouped = written(hubs.groupBy(*use).agg(F.collect_list("hub").alias("hubs")), "hubs")
    by = lambda where: hierarchy.dealt_join(grouped.where(where).select(*use, F.explode("hubs").alias("hub")), held, ["hub"], F.struct(*use)).select(*use, "origin")
    out = direct.join(again, [*use, "origin"], "left_anti").unionByName(by("size(hubs) = 1")).unionByName(by("size(hubs) > 1").distinct())
    return out.select("method", "stmt", "origin", "base", "path")


def gated(program: Program, seeds_: DataFrame, sinks: DataFrame, objects: DataFrame, contexts: DataFrame, conditions: DataFrame, unbalanced: bool = False) -> DataFrame:
    """reached() without the flows whose sink's condition on its object doesn't hold.

    objects (method, stmt, base) are what conditional sinks are called on, contexts (method, stmt,
    base, name) statements that make an object in a way that has a name, and conditions (method,
    stmt, wanted, unwanted) say, as arrays of names, that the object must come from one of the wanted
    contexts, if there are any, and from none of the unwanted. The secondary flows are found
    backwards through calls, and only from sinks that a fact has reached. A sink without
    a condition keeps its flows; an object without known contexts has none of the wanted.
    """
    at = ["method", "stmt"]
    found = written(reached(tabulated(program, seeds_, unbalanced), sinks), "flows")
    asked = objects.join(conditions, at, "left_semi").join(found, at, "left_semi")
    second = tabulated(converse(program).written(), seeds(asked), unbalanced)
    names = reached(second, contexts).join(contexts.distinct(), [*at, "base"]).groupBy("origin").agg(F.collect_set("name").alias("names"))
    none = F.array().cast("array<string>")
    rows = conditions.withColumn("origin", F.concat("method", F.lit(":"), F.col("stmt").cast("string"))).join(names, "origin", "left").withColumn("names", F.coalesce("names", none))
    any_of = lambda c: F.coalesce(F.arrays_overlap(F.coalesce(c, none), "names"), F.lit(False))
    broken = rows.where((F.size(F.coalesce("wanted", none)) > 0) & ~any_of("wanted") | any_of("unwanted"))
    return found.join(broken, at, "left_anti")


def seeds(at: DataFrame) -> DataFrame:
    """Facts (method, stmt, base) that begin after their statement; their origin is method:stmt."""
    origin = F.concat(F.lit("0|"), "method", F.lit(":"), F.col("stmt").cast("string"))
    return at.select("method", origin.alias("entry"), F.col("stmt").cast("long").alias("stmt"), "base", F.lit("").alias("path"))


def compiled(stmts: DataFrame, cfg: DataFrame, params: DataFrame, wrappers: DataFrame | None = None, clears: DataFrame | None = None) -> Program:
    """The program of taint.STATEMENT rows: one rule a row and kind of statement.

    cfg is (method, src, dst), params (method, names array). wrappers are flows of library
    methods without a body: (callee, base, path, to, to_path) with places arg0, arg1, ..., base
    and return; clears, (callee, base, path), what they empty.
    """
    none = "coalesce({}, '')"
    flow = lambda where, base, path, to, to_path: stmts.where(where).selectExpr("method", "stmt", f"{base} AS base", f"{path} AS path", f"{to} AS to", f"{to_path} AS to_path")
    flows = _union([
        flow("kind = 'assign' AND rhs IS NOT NULL AND coalesce(rhs_field, '') <> 'len'", "rhs", none.format("rhs_field"), "lhs", none.format("lhs_field")),
        flow("kind = 'cast'", "rhs", "''", "lhs", "''"), flow("kind = 'throw'", "rhs", "''", "'@exc'", "''"),
        flow("kind = 'catch'", "'@exc'", "''", "lhs", "''"), flow("kind = 'return' AND rhs IS NOT NULL", "rhs", "''", "'@ret'", "''"),
    ])
    kills = stmts.where("kind IN ('assign', 'cast', 'source', 'call', 'catch') AND lhs IS NOT NULL AND coalesce(lhs_field, '') <> '[]'").selectExpr("method", "stmt", "lhs AS base", "coalesce(lhs_field, '') AS path")
    kills = kills.unionByName(stmts.where("kind = 'catch'").selectExpr("method", "stmt", "'@exc' AS base", "'' AS path"))

    calls = stmts.where("kind = 'call'")
    named = calls.join(params.withColumnRenamed("method", "callee"), "callee")
    zipped = named.select("method", "stmt", "callee", "lhs", F.explode(F.arrays_zip("args", "names")).alias("x")).where("x.args IS NOT NULL AND x.names IS NOT NULL")
    lost = "actual <=> lhs AS overwritten"  # an object whose name gets the result is out of sight
    pairs = zipped.selectExpr("method", "stmt", "callee", "lhs", "x.args AS actual", "x.names AS formal").selectExpr("*", lost)
    pairs = pairs.unionByName(named.where("base IS NOT NULL").selectExpr("method", "stmt", "callee", "lhs", "base AS actual", "'@this' AS formal").selectExpr("*", lost))
    fields = stmts.select("method", F.explode(F.array("lhs", "rhs")).alias("field")).where("startswith(field, 'static ')").distinct()
    touched = frontend.static_uses(calls.select(F.col("method").alias("src"), F.col("callee").alias("dst")).distinct(), fields)
    statics = named.select("method", "stmt", "callee").join(touched.select(F.col("method").alias("callee"), F.col("field").alias("base")), "callee")
    kills = kills.unionByName(statics.selectExpr("method", "stmt", "base", "'' AS path"))
    enters = pairs.selectExpr("method", "stmt", "callee", "actual AS base", "formal AS to").unionByName(statics.selectExpr("method", "stmt", "callee", "base", "base AS to"))
    leave = lambda df, base, to, deep: df.selectExpr("callee", "method", "stmt", f"{base} AS base", f"{to} AS to", f"{deep} AS deep")
    leaves = _union([
        leave(named.where("lhs IS NOT NULL"), "'@ret'", "lhs", "false"), leave(named, "'@exc'", "'@exc'", "false"),
        leave(pairs.where("NOT overwritten"), "formal", "actual", "true"), leave(statics, "base", "base", "false"),
    ])

    if wrappers is not None or clears is not None:
        place = F.posexplode("args").alias("i", "name")
        places = calls.select("method", "stmt", "callee", place).selectExpr("method", "stmt", "callee", "concat('arg', i) AS place", "name")
        for what, column in (("base", "base"), ("return", "lhs")):
            places = places.unionByName(calls.where(f"{column} IS NOT NULL").selectExpr("method", "stmt", "callee", f"'{what}' AS place", f"{column} AS name"))
        at = lambda side: places.select("method", "stmt", "callee", F.col("place").alias(side), F.col("name").alias(f"{side}_name"))
        if wrappers is not None:
            made = wrappers.join(at("base"), ["callee", "base"]).join(at("to"), ["method", "stmt", "callee", "to"])
            flows = flows.unionByName(made.selectExpr("method", "stmt", "base_name AS base", "path", "to_name AS to", "to_path"))
        if clears is not None:
            kills = kills.unionByName(clears.join(at("base"), ["callee", "base"]).selectExpr("method", "stmt", "base_name AS base", "path"))
    last = stmts.select("method", F.col("stmt").alias("src")).join(cfg.select("method", "src"), ["method", "src"], "left_anti")
    edges = cfg.select("method", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).unionByName(last.selectExpr("method", "src", f"{EXIT}L AS dst"))
    return Program(edges, flows, kills, enters, leaves, stmts.groupBy("method").agg(F.min("stmt").alias("stmt"))).written()


def with_models(program: Program, stmts: DataFrame, models: DataFrame, gaps: DataFrame, params: DataFrame, clears: DataFrame | None = None, fallback: bool = False) -> Program:
    """The program with models of library methods as methods of one statement, which loops: an inner fixpoint.

    models are flows (callee, base, path, to, to_path) between the places arg0, arg1, ..., base,
    return and those of gaps, such as gap1.arg0; a gap (callee, gap, target) is a call that
    the library makes back into the program: its places are bound to the target's formals
    (params: method, names), so a flow stops at the gap, enters the target and goes on from
    what comes back. A modelled method's own body is not entered. clears (callee, base, path)
    are emptied by the call. With fallback a method without model or body takes its
    arguments and its object to its result.
    """
    calls = stmts.where("kind = 'call'")
    known = models.select("callee").unionByName(gaps.select("callee"))
    known = written((known if clears is None else known.unionByName(clears.select("callee"))).distinct(), "modelled")
    listed = calls.select("method", "stmt", "callee", "lhs", F.posexplode("args").alias("i", "actual")).selectExpr("method", "stmt", "callee", "lhs", "actual", "concat('arg', i) AS place")
    listed = listed.unionByName(calls.where("base IS NOT NULL").selectExpr("method", "stmt", "callee", "lhs", "base AS actual", "'base' AS place"))
    places = written(listed.join(known, "callee", "left_semi"), "places")
    changed = models.select("callee", F.col("to").alias("place")).distinct()
    inner = models.selectExpr("callee AS method", "1L AS stmt", "base", "path", "to", "to_path")
    inside = known.selectExpr("callee AS method")

    bound = gaps.join(params.withColumnRenamed("method", "target"), "target").select("callee", "gap", "target", F.posexplode("names").alias("i", "formal"))
    bound = bound.selectExpr("callee AS method", "target", "concat(gap, '.arg', i) AS place", "formal")
    this = gaps.selectExpr("callee AS method", "target", "concat(gap, '.base') AS place", "'@this' AS formal")
    bound = bound.unionByName(this)
    enters = program.enters.join(known, "callee", "left_anti").unionByName(places.selectExpr("method", "stmt", "callee", "actual AS base", "place AS to"))
    enters = enters.unionByName(bound.selectExpr("method", "1L AS stmt", "target AS callee", "place AS base", "formal AS to"))
    leave = lambda df, callee, base, to, deep: df.selectExpr(f"{callee} AS callee", "method", "stmt", f"{base} AS base", f"{to} AS to", f"{deep} AS deep")
    gap_sites = bound.withColumn("stmt", F.lit(1).cast("long"))
    leaves = _union([
        program.leaves.join(known, "callee", "left_anti").select(*program.leaves.columns),
        leave(places.join(changed, ["callee", "place"]).where("NOT actual <=> lhs"), "callee", "place", "actual", "true"),
        leave(calls.join(known, "callee", "left_semi").where("lhs IS NOT NULL"), "callee", "'return'", "lhs", "false"),
        leave(gap_sites, "target", "formal", "place", "true"),
        leave(gaps.selectExpr("callee AS method", "gap", "target", "1L AS stmt"), "target", "'@ret'", "concat(gap, '.return')", "false"),
    ])
    flows, kills = program.flows.unionByName(inner), program.kills
    if clears is not None:
        kills = kills.unionByName(places.join(clears.withColumnRenamed("base", "place"), ["callee", "place"]).selectExpr("method", "stmt", "actual AS base", "path"))
    if fallback:
        free = calls.join(known, "callee", "left_anti").join(params.select(F.col("method").alias("callee")), "callee", "left_anti").where("lhs IS NOT NULL")
        given = free.select("method", "stmt", "lhs", F.explode(F.array_compact(F.concat("args", F.array("base")))).alias("base"))
        flows = flows.unionByName(given.selectExpr("method", "stmt", "base", "'' AS path", "lhs AS to", "'' AS to_path"))
    loop = inside.selectExpr("method", "1L AS src", f"explode(array(1L, {EXIT}L)) AS dst")
    return Program(program.edges.unionByName(loop), flows, kills, enters, leaves, program.starts.unionByName(inside.selectExpr("method", "1L AS stmt")), program.moves).written()


def with_containers(program: Program, ops: DataFrame, widening: str = "revisit", smash: bool = False, most: int = MAX_PLACE) -> Program:
    """The program with operations of lists and maps, whose facts know the place or the key of a value.

    ops: (method, stmt, base, kind, op, at, value, lhs); kind is list or map, at a constant place
    or key as text, null where it isn't known. op is new, clear, add (list: puts a value before the one
    at a place), append (at: the place, if known), set (list, and a map's put), remove or get; lhs takes
    what get and remove give. A known place or key that gets a value loses what it had. widening
    says where a moved place is opened: shift (whenever it moves), revisit (where the same statement
    has moved what it comes from) or none (past most only, as with the others). smash keeps no
    places or keys: a value is anywhere in its container, until that is cleared. Other names of a
    container see what is put in it (``with_aliases``), but their places don't move with it.
    """
    if widening not in ("revisit", "shift", "none"):
        raise ValueError(f"no such widening: {widening}")
    known = F.col("at").isNotNull() & ~F.lit(smash)
    mark = F.when(F.col("kind") == "list", "#").otherwise("$")
    key = F.when(F.col("kind") == "list", F.col("at").cast("string")).otherwise(F.replace(F.replace("at", F.lit("%"), F.lit("%25")), F.lit("."), F.lit("%2E")))
    rows = written(ops.select("*", F.concat(mark, F.when(known, key).otherwise("*")).alias("field"), known.alias("known"), mark.alias("mark")), "containers")
    put = rows.where("op IN ('add', 'append', 'set') AND value IS NOT NULL").selectExpr("method", "stmt", "value AS base", "'' AS path", "base AS to", "field AS to_path")
    got = rows.where("op IN ('get', 'remove') AND lhs IS NOT NULL").selectExpr("method", "stmt", "base", "field AS path", "lhs AS to", "'' AS to_path")
    lost = rows.where("op IN ('new', 'clear')").selectExpr("method", "stmt", "base", "mark AS path")
    lost = lost.unionByName(rows.where("known AND (op = 'set' OR op = 'remove' AND kind = 'map')").selectExpr("method", "stmt", "base", "field AS path"))
    lost = lost.unionByName(rows.where("lhs IS NOT NULL").selectExpr("method", "stmt", "lhs AS base", "'' AS path"))
    shifts = rows.where("kind = 'list' AND op IN ('add', 'remove')" + (" AND false" if smash else ""))
    far = -1 if widening == "shift" else most
    moves = shifts.selectExpr("method", "stmt", "base", "CAST(at AS INT) AS at", "IF(op = 'add', 1, -1) AS by", f"{far} AS most", f"{widening == 'revisit'} AS revisit")
    if program.moves is not None:
        moves = moves.unionByName(program.moves)
    return replace(program, flows=program.flows.unionByName(put).unionByName(got), kills=program.kills.unionByName(lost), moves=moves).written()


def nearest_postdominators(edges: DataFrame) -> DataFrame:
    """(method, stmt, post): the nearest statement that every way from stmt to EXIT passes; none where there is no such statement."""
    back = edges.selectExpr("method", "dst AS src", "src AS dst")
    ends = edges.select("method").distinct().withColumn("node", F.lit(EXIT).cast("long"))
    over = recursion.dominators(back, ends).where(f"node <> {EXIT} AND dominator <> {EXIT}")
    over = written(over, "postdominators")
    depth = over.groupBy("method", F.col("node").alias("dominator")).agg(F.count("*").alias("n"))
    return over.where("node <> dominator").join(depth, ["method", "dominator"]).groupBy("method", F.col("node").alias("stmt")).agg(F.max_by("dominator", "n").alias("post"))


def with_implicit(program: Program, stmts: DataFrame) -> tuple[Program, DataFrame]:
    """The program where what a tainted condition decides is tainted, also in methods called meanwhile, and the sinks that it decides.

    A tainted condition opens a context, a fact of its own that ends at the condition's nearest
    postdominator (``@ctx post``, or ``@ctx`` where there is none); nested conditions have one
    each. What is assigned while it is open is tainted by it. A call hands every open context
    to the callee as ``@ctx``, which stays open to the callee's end and doesn't come back. The sinks
    are rows (method, stmt, base) for ``reached``.
    """
    none = F.lit("").alias("path")
    conditions = stmts.where("kind = 'if' AND rhs IS NOT NULL").select("method", "stmt", "rhs").join(nearest_postdominators(program.edges), ["method", "stmt"], "left")
    conditions = written(conditions.select("method", "stmt", "rhs", "post", F.concat_ws(" ", F.lit("@ctx"), F.col("post").cast("string")).alias("context")), "conditions")
    contexts = conditions.select("method", "context", "post").distinct()
    contexts = written(contexts.unionByName(stmts.selectExpr("method", "'@ctx' AS context", "CAST(NULL AS BIGINT) AS post").distinct()).distinct(), "contexts")
    open_ = F.expr("post IS NULL OR post <> stmt")
    opened = conditions.selectExpr("method", "stmt", "rhs AS base", "'' AS path", "context AS to", "'' AS to_path")
    decided = stmts.where("kind IN ('assign', 'cast') AND lhs IS NOT NULL").join(contexts, "method").where(open_)
    flows = opened.unionByName(decided.selectExpr("method", "stmt", "context AS base", "'' AS path", "lhs AS to", "coalesce(lhs_field, '') AS to_path"))
    kills = contexts.where("post IS NOT NULL").select("method", F.col("post").alias("stmt"), F.col("context").alias("base"), none)
    bodies = program.starts.select(F.col("method").alias("callee"))
    into = stmts.where("kind = 'call'").join(bodies, "callee", "left_semi").join(contexts, "method").where(open_).selectExpr("method", "stmt", "callee", "context AS base", "'@ctx' AS to")
    sinks = stmts.where("kind = 'sink'").join(contexts, "method").where(open_).select("method", "stmt", F.col("context").alias("base"))
    made = replace(program, flows=program.flows.unionByName(flows), kills=program.kills.unionByName(kills), enters=program.enters.unionByName(into))
    return made.written(), sinks
