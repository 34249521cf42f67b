"""Taint tabulation: facts flow along control flow, calls and returns until nothing is new.

A method's statements are solved together in one task by a worklist, since they all see the
same facts; Spark carries what passes between methods. A round solves the methods that got
new entry facts or new summaries of methods they call, so the number of rounds follows the
depth of calls, not the length of methods. End summaries are kept by (method, entry fact),
so a method is solved once for each way it is entered.

Facts are ``source|base|field.field``; the empty fact ``0`` holds everywhere. Access paths
keep at most MAX_FIELDS fields; a path stands for all paths that begin with it.

Statements are rows of STATEMENT. kinds: assign (lhs[.lhs_field] = rhs[.rhs_field]; without
rhs a constant), source (lhs = a secret), sink (args), call (lhs = callee(args), base for
instance calls), return (rhs), if (rhs), throw (rhs), catch (lhs), cast (lhs = (type) rhs).
Array elements are the field [], lengths the field len. Names that begin with ``static `` are
shared by all methods.
"""

from __future__ import annotations

import itertools
from collections import defaultdict, deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailhead.operators import frontend
from trailhead.storage import checkpointed, in_frames

MAX_FIELDS = 5
STATEMENT = "method string, stmt long, kind string, lhs string, lhs_field string, rhs string, rhs_field string, callee string, base string, args array<string>, type string"
ZERO = "0"


@dataclass
class Rules:
    """Which rules hold. casts: pairs (value type, cast type) that are possible, None for all."""

    implicit: bool = False
    strong_updates: bool = True
    statics: bool = True
    casts: set | None = None
    wrappers: dict = field(default_factory=dict)  # callee to flows (from, from_fields, to, to_fields); "kill" lists what is cleared


def parse(fact: str):
    source, base, path = fact.split("|", 2)
    return source, base, tuple(path.split(".")) if path else ()


def fact(source: str, base: str, fields=()) -> str:
    return f"{source}|{base}|{'.'.join(fields[:MAX_FIELDS])}"


def _after(fields, wanted):
    """What is left of a fact's fields once the wanted ones are read; None where they differ."""
    n = min(len(fields), len(wanted))
    return tuple(fields[len(wanted) :]) if tuple(fields[:n]) == tuple(wanted[:n]) else None


def _regions(succ, nodes):
    """For each node the nodes between it and its nearest common later node."""
    ends = {n for n in nodes if not succ.get(n)}
    post = {n: ({n} if n in ends else set(nodes)) for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in reversed(nodes):
            if n not in ends:
                new = set.intersection(*(post[m] for m in succ[n])) | {n}
                if new != post[n]:
                    post[n], changed = new, True
    out = {}
    for n in nodes:
        later, seen, queue = post[n] - {n}, set(), deque(succ.get(n, ()))
        while queue:
            m = queue.popleft()
            if m not in seen and m not in later:
                seen.add(m)
                queue.extend(succ.get(m, ()))
        out[n] = seen
    return out


def solve_method(method, stmts: list[dict], succ: dict, entries, summaries, params: dict, rules: Rules, uses: dict | None = None):
    """(exits, calls, hits) of one method: facts at its end by entry fact, facts that enter callees, and sinks reached.

    summaries: callee to {entry fact: set of exit facts}; params: method to its formal names;
    uses: callee to the statics that it or what it calls touches (None: any).
    """
    by_id = {s["stmt"]: s for s in stmts}
    order = [s["stmt"] for s in stmts]
    aliases = defaultdict(set)  # copies of references, either way
    for s in stmts:
        if s["kind"] in ("assign", "cast") and s["rhs"] and not s["lhs_field"] and not s["rhs_field"]:
            aliases[s["lhs"]].add(s["rhs"])
            aliases[s["rhs"]].add(s["lhs"])
    region = _regions(succ, order) if rules.implicit else {}
    exits, calls, hits = set(), set(), set()
    start = order[0]
    seen, queue = set(), deque()

    def push(d1, n, d2):
        if (d1, n, d2) not in seen:
            seen.add((d1, n, d2))
            queue.append((d1, n, d2))

    def stored(source, lhs, lhs_field, fields):
        if not rules.statics and lhs.startswith("static "):
            return []
        if not lhs_field:
            return [fact(source, lhs, fields)]
        names, stack = {lhs}, [lhs]
        while stack:
            for other in aliases[stack.pop()]:
                if other not in names:
                    names.add(other)
                    stack.append(other)
        return [fact(source, name, (lhs_field, *fields)) for name in names]

    for e in entries:
        push(e, start, e)
        push(e, start, ZERO)
    while queue:
        d1, n, d2 = queue.popleft()
        s, out = by_id[n], set()
        kind = s["kind"]
        if d2 == ZERO:
            out.add(ZERO)
            if kind == "source":
                out.update(stored(str(n), s["lhs"], s["lhs_field"], ()))
            if kind == "call" and s["callee"] in params:
                calls.add((s["callee"], ZERO))
                for x in summaries.get(s["callee"], {}).get(ZERO, ()):
                    out.update(_returned(x, s, params))
        else:
            source, base, fields = parse(d2)
            keep = True
            if rules.strong_updates and s["lhs"] == base and kind in ("assign", "cast", "source", "call", "catch"):
                keep = bool(s["lhs_field"]) and (s["lhs_field"] == "[]" or _after(fields, (s["lhs_field"],)) is None or not fields)
            if not rules.statics and base.startswith("static "):
                keep = False
            if kind in ("assign", "cast") and s["rhs"] == base:
                allowed = kind == "assign" or rules.casts is None or (s["rhs_field"], s["type"]) in rules.casts
                wanted = (s["rhs_field"],) if s["rhs_field"] and kind == "assign" else ()
                rest = _after(fields, wanted)
                if allowed and rest is not None and not (wanted == ("len",) and not fields):
                    out.update(stored(source, s["lhs"], s["lhs_field"], rest))
            elif kind == "sink" and base in s["args"]:
                hits.add((d1, n, d2))
            elif kind == "if" and rules.implicit and s["rhs"] == base:
                for m in region[n]:
                    guarded = by_id[m]
                    if guarded["kind"] in ("assign", "cast") and guarded["lhs"]:
                        for x in stored(source, guarded["lhs"], guarded["lhs_field"], ()):
                            for after in succ.get(m, ()):
                                push(d1, after, x)
            elif kind == "throw" and s["rhs"] == base:
                out.add(fact(source, "@exc", fields))
            elif kind == "catch" and base == "@exc":
                out.add(fact(source, s["lhs"], fields))
                keep = False
            elif kind == "return" and s["rhs"] == base:
                exits.add((d1, fact(source, "@ret", fields)))
            elif kind == "call":
                keep = _call(s, source, base, fields, keep, out, calls, summaries, params, rules, uses)
            if keep:
                out.add(d2)
        following = succ.get(n, ())
        if not following:
            own = set(params.get(method, ())) | {"@exc", "@this"}
            for x in out:
                if x != ZERO:
                    _, b, f = parse(x)
                    if b.startswith("static ") or b == "@exc" or b in own and f:
                        exits.add((d1, x))
        for m in following:
            for x in out:
                push(d1, m, x)
    return exits, calls, hits


def _call(s, source, base, fields, keep, out, calls, summaries, params, rules, uses):
    callee, args = s["callee"], s["args"]
    if callee in params:
        inside = [fact(source, formal, fields) for formal, actual in zip(params[callee], args, strict=False) if actual == base]
        if s["base"] == base:
            inside.append(fact(source, "@this", fields))
        if base.startswith("static ") and (uses is None or base in uses.get(callee, ())):
            inside.append(fact(source, base, fields))
            keep = False  # the callee decides what stays; one that never touches the static is passed by
        for x in inside:
            calls.add((callee, x))
            for y in summaries.get(callee, {}).get(x, ()):
                out.update(_returned(y, s, params))
        return keep
    flows = rules.wrappers.get(callee)
    if flows:
        place = {"return": s["lhs"], "base": s["base"], **{f"arg{i}": a for i, a in enumerate(args)}}
        for where, path in flows.get("kill", ()):
            if place.get(where) == base and _after(fields, path) is not None and len(fields) >= len(path):
                keep = False
        for start, path, end, to in flows["flows"]:
            if place.get(start) == base and place.get(end):
                rest = _after(fields, path)
                if rest is not None:
                    out.add(fact(source, place[end], (*to, *rest)))
    return keep


def _returned(exit_fact, s, params):
    """Facts at the caller for a fact at the end of the callee."""
    source, base, fields = parse(exit_fact)
    if base == "@ret":
        return [fact(source, s["lhs"], fields)] if s["lhs"] else []
    if base.startswith("static ") or base == "@exc":
        return [exit_fact]
    names = dict(zip(params[s["callee"]], s["args"], strict=False)) | {"@this": s["base"]}
    return [fact(source, names[base], fields)] if names.get(base) else []


def flows(stmts: DataFrame, cfg: DataFrame, params: DataFrame, roots: DataFrame, rules: Rules | None = None, max_rounds: int | None = None) -> DataFrame:
    """(method, sink, source, fact): sinks that facts reach from the source statements.

    stmts are rows of STATEMENT; cfg is (method, src, dst); params is (method, names array);
    roots is (method). Formal names are needed at calls only, so each method's rows carry
    those of its callees, found by one join.
    """
    entries = roots.select("method", F.lit(ZERO).alias("entry"))
    hits, _ = _tabulated(stmts, cfg, params, entries, rules or Rules(), max_rounds)
    parts = F.split("exit", r"\|")
    return hits.select("method", F.col("stmt").alias("sink"), parts[0].cast("long").alias("source"), F.concat_ws(".", parts[1], F.nullif(parts[2], F.lit(""))).alias("fact")).distinct()


def generated(stmts: DataFrame, cfg: DataFrame, params: DataFrame, rules: Rules | None = None, max_rounds: int | None = None) -> DataFrame:
    """(method, from_param, to, fields): what each method does to its parameters, as summary flows.

    Every formal enters as a source of its own; to is Return, Parameter i, Base, Exception or a
    static's name. An entry fact that only stays where it is makes no flow.
    """
    formals = params.select("method", F.posexplode("names").alias("i", "name"))
    entries = formals.select("method", F.concat(F.lit("p"), F.col("i").cast("string"), F.lit("|"), "name", F.lit("|")).alias("entry"))
    _, exits = _tabulated(stmts, cfg, params, entries, rules or Rules(), max_rounds)
    parts = F.split("exit", r"\|")
    rows = exits.where("entry <> '0' AND startswith(exit, 'p')").select("method", parts[0].alias("source"), parts[1].alias("base"), parts[2].alias("fields"))
    rows = rows.join(formals.select("method", F.col("name").alias("base"), F.col("i").alias("to_param")), ["method", "base"], "left")
    to = F.when(F.col("base") == "@ret", "Return").when(F.col("base") == "@this", "Base").when(F.col("base") == "@exc", "Exception").when(F.col("to_param").isNotNull(), F.concat(F.lit("Parameter "), F.col("to_param").cast("string"))).otherwise(F.col("base"))
    return rows.select("method", F.expr("substring(source, 2)").cast("int").alias("from_param"), to.alias("to"), "fields").distinct()


def _tabulated(stmts: DataFrame, cfg: DataFrame, params: DataFrame, entries: DataFrame, rules: Rules, max_rounds: int | None):
    """Sinks reached (what, method, entry, exit, stmt) and summaries (method, entry, exit)."""
    # a method's whole program text as one row, with the formals of itself and its callees
    formals = params.select(F.col("method").alias("callee"), "names")
    body = stmts.groupBy("method").agg(F.array_sort(F.collect_list(F.struct("stmt", "kind", "lhs", "lhs_field", "rhs", "rhs_field", "callee", "base", "args", "type"))).alias("body"))
    edges = cfg.groupBy("method").agg(F.collect_set(F.struct("src", "dst")).alias("edges"))
    calls = stmts.where("callee IS NOT NULL").select("method", "callee").unionByName(params.select("method", F.col("method").alias("callee"))).distinct()
    known = calls.join(formals, "callee").groupBy("method").agg(F.collect_list(F.struct("callee", "names")).alias("formals"))
    statics = stmts.select("method", F.explode(F.array("lhs", "rhs", "base")).alias("field")).unionByName(stmts.select("method", F.explode("args").alias("field"))).where("startswith(field, 'static ')")
    touched = frontend.static_uses(calls.select(F.col("method").alias("src"), F.col("callee").alias("dst")), statics)
    theirs = calls.join(touched.select(F.col("method").alias("callee"), "field"), "callee").groupBy("method").agg(F.collect_set(F.struct("callee", "field")).alias("statics"))
    program = checkpointed(body.join(edges, "method", "left").join(known, "method", "left").join(theirs, "method", "left"))
    uses = checkpointed(calls)

    entries = checkpointed(entries.distinct())
    summaries = all_hits = None
    dirty = entries.select("method").distinct()
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        given = entries.groupBy("method").agg(F.collect_set("entry").alias("entries"))
        work = program.join(dirty, "method", "left_semi").join(given, "method")
        if summaries is not None:
            theirs = uses.join(summaries.select(F.col("method").alias("callee"), "entry", "exit"), "callee")
            theirs = theirs.groupBy("method").agg(F.collect_list(F.struct("callee", "entry", "exit")).alias("summaries"))
            work = work.join(theirs, "method", "left")
        else:
            work = work.withColumn("summaries", F.lit(None).cast("array<struct<callee:string,entry:string,exit:string>>"))

        def run(frames):
            for frame in frames:
                out = []
                for row in frame.itertuples(index=False):
                    body_ = [{**s, "args": [] if s["args"] is None else list(s["args"])} for s in map(dict, row.body)]
                    succ = defaultdict(list)
                    for e in row.edges if row.edges is not None else ():
                        succ[e["src"]].append(e["dst"])
                    names = {f["callee"]: list(f["names"]) for f in (row.formals if row.formals is not None else ())}
                    held = defaultdict(lambda: defaultdict(set))
                    for s in row.summaries if row.summaries is not None else ():
                        held[s["callee"]][s["entry"]].add(s["exit"])
                    touched_ = defaultdict(set)
                    for s in row.statics if row.statics is not None else ():
                        touched_[s["callee"]].add(s["field"])
                    exits, made, hits = solve_method(row.method, body_, succ, list(row.entries), held, names, rules, touched_)
                    out += [("exit", row.method, d1, x, None) for d1, x in exits] + [("call", c, x, None, None) for c, x in made] + [("hit", row.method, d1, d2, n) for d1, n, d2 in hits]
                yield pd.DataFrame(out, columns=["what", "method", "entry", "exit", "stmt"]).astype({"stmt": "Int64"})

        found = checkpointed(in_frames(work, run, "what string, method string, entry string, exit string, stmt long").distinct())
        hits = found.where("what = 'hit'")
        all_hits = hits if all_hits is None else all_hits.unionByName(hits)
        exits = found.where("what = 'exit'").select("method", "entry", "exit")
        new_exits = exits if summaries is None else exits.join(summaries, ["method", "entry", "exit"], "left_anti")
        new_entries = found.where("what = 'call'").select("method", "entry").join(entries, ["method", "entry"], "left_anti")
        new_exits, new_entries = checkpointed(new_exits), checkpointed(new_entries)
        callers = uses.join(new_exits.select(F.col("method").alias("callee")).distinct(), "callee", "left_semi").select("method")
        dirty = callers.unionByName(new_entries.select("method")).distinct()
        summaries = new_exits if summaries is None else checkpointed(summaries.unionByName(new_exits))
        entries = checkpointed(entries.unionByName(new_entries))
        dirty = checkpointed(dirty.join(entries.select("method").distinct(), "method", "left_semi"))
        if dirty.isEmpty():
            break
    return all_hits, summaries


def without_entailed(found: DataFrame) -> DataFrame:
    """Drops facts that a shorter access path at the same sink and source covers."""
    other = found.select("method", "sink", "source", F.col("fact").alias("wider"))
    covered = F.expr("fact <> wider AND startswith(fact, concat(wider, '.'))")
    return found.join(other, ["method", "sink", "source"]).where(covered).select("method", "sink", "source", "fact").distinct().transform(lambda d: found.join(d, ["method", "sink", "source", "fact"], "left_anti"))


def conditional(found: DataFrame, conditions: DataFrame, reached: DataFrame, above: DataFrame) -> DataFrame:
    """Flows whose sink's condition holds.

    conditions: (sink, signatures, classes, excluded), arrays; reached: (source, sink, sig, class)
    of the secondary analysis, above: (sub, sup) of the hierarchy. A condition holds if it is
    empty, or else if any signature and any class matches (an empty list counts as a match),
    and no excluded class is the source's base type or above it; without secondary results
    it does not hold.
    """
    wide = reached.join(above.select(F.col("sub").alias("class"), "sup"), "class", "left").groupBy("source", "sink").agg(F.collect_set("sig").alias("sigs"), F.array_union(F.collect_set("class"), F.collect_set("sup")).alias("seen"))
    rows = found.join(conditions, "sink", "left").join(wide, ["source", "sink"], "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    empty = (size("signatures") + size("classes") + size("excluded")) == 0
    match = lambda wanted, got: (size(wanted) == 0) | F.coalesce(F.arrays_overlap(wanted, got), F.lit(False))
    holds = F.col("sigs").isNotNull() & match("signatures", "sigs") & match("classes", "seen") & ~F.coalesce(F.arrays_overlap("excluded", "seen"), F.lit(False))
    return rows.where(empty | holds).select(*found.columns)


def trace_back(stmts: list[dict], pred: dict) -> set[tuple]:
    """(sink, source, argument) of one method: from each sink's argument over the statements before it.

    An entry (n, var, sink, arg) says that the value of var before n reaches the sink. A statement
    that defines var by another variable goes on with that, a source is a result, and any other
    definition ends it.
    """
    by_id = {s["stmt"]: s for s in stmts}
    queue = deque((s["stmt"], a, s["stmt"], a) for s in stmts if s["kind"] == "sink" for a in s["args"])
    seen, found = set(queue), set()
    while queue:
        n, var, sink, arg = queue.popleft()
        for m in pred.get(n, ()):
            s, now = by_id[m], var
            if s["lhs"] == var and s["kind"] in ("assign", "cast", "source", "call", "catch"):
                if s["kind"] == "source":
                    found.add((sink, m, arg))
                now = s["rhs"] if s["kind"] in ("assign", "cast") else None
            entry = (m, now, sink, arg)
            if now and entry not in seen:
                seen.add(entry)
                queue.append(entry)
    return found


def backward(stmts: DataFrame, cfg: DataFrame) -> DataFrame:
    """(method, sink, source, fact): from each argument of a sink back to the source statements that it comes from, within a method.

    A method's statements are one row and are traced in one task, as in ``flows``.
    """
    body = stmts.groupBy("method").agg(F.collect_list(F.struct("stmt", "kind", "lhs", "rhs", "args")).alias("body"))
    edges = cfg.groupBy("method").agg(F.collect_set(F.struct("src", "dst")).alias("edges"))

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                pred = defaultdict(list)
                for e in row.edges if row.edges is not None else ():
                    pred[e["dst"]].append(e["src"])
                own = [{**s, "args": [] if s["args"] is None else list(s["args"])} for s in map(dict, row.body)]
                out += [(row.method, *x) for x in trace_back(own, pred)]
            yield pd.DataFrame(out, columns=["method", "sink", "source", "fact"])

    return in_frames(body.join(edges, "method", "left"), run, "method string, sink long, source long, fact string")
