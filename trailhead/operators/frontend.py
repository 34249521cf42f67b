"""Front-end relations: callbacks, entry points, component links and synthetic call edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailhead.operators import hierarchy, recursion
from trailhead.storage import checkpointed

# Lifecycle callbacks of each kind of component, in the order in which they run.
LIFECYCLES = {
    "Activity": ("onCreate", "onStart", "onRestoreInstanceState", "onPostCreate", "onResume", "onPostResume", "onPause", "onSaveInstanceState", "onStop", "onRestart", "onDestroy"),
    "Service": ("onCreate", "onStart", "onStartCommand", "onBind", "onRebind", "onUnbind", "onDestroy"),
    "BroadcastReceiver": ("onReceive",),
    "ContentProvider": ("onCreate", "insert", "query", "update", "delete", "getType"),
    "Fragment": ("onAttach", "onCreate", "onCreateView", "onViewCreated", "onStart", "onResume", "onPause", "onStop", "onDestroyView", "onDestroy", "onDetach"),
    "Application": ("onCreate", "onTerminate"),
    "ServiceConnection": ("onServiceConnected", "onServiceDisconnected"),
    "GCMBaseIntentService": ("onDeletedMessages", "onError", "onMessage", "onRecoverableError", "onRegistered", "onUnregistered"),
    "GcmListenerService": ("onDeletedMessages", "onMessageReceived", "onMessageSent", "onSendError"),
    "HostApduService": ("processCommandApdu", "onDeactivated"),
    "ActivityLifecycleCallbacks": ("onActivityCreated", "onActivityStarted", "onActivityResumed", "onActivityPaused", "onActivityStopped", "onActivitySaveInstanceState", "onActivityDestroyed"),
    "ComponentCallbacks": ("onLowMemory", "onConfigurationChanged"),
    "ComponentCallbacks2": ("onTrimMemory",),
}
# Library methods that run code given to them: which of receiver (0) and arguments (1, ...), and what is called on it.
PATCHES = (
    ("<java.lang.Thread: void start()>", 0, "void run()"),
    ("<java.lang.Thread: void <init>(java.lang.Runnable)>", 1, "void run()"),
    ("<java.lang.Thread: void <init>(java.lang.Runnable,java.lang.String)>", 1, "void run()"),
    ("<android.os.Handler: boolean post(java.lang.Runnable)>", 1, "void run()"),
    ("<android.os.Handler: boolean postAtTime(java.lang.Runnable,long)>", 1, "void run()"),
    ("<android.os.Handler: boolean postDelayed(java.lang.Runnable,long)>", 1, "void run()"),
    ("<android.os.Handler: boolean postAtFrontOfQueue(java.lang.Runnable)>", 1, "void run()"),
    ("<android.os.Handler: void dispatchMessage(android.os.Message)>", 0, "void handleMessage(android.os.Message)"),
    ("<android.os.Handler: boolean sendMessage(android.os.Message)>", 0, "void handleMessage(android.os.Message)"),
    ("<java.util.Timer: void schedule(java.util.TimerTask,long)>", 1, "void run()"),
    ("<java.util.Timer: void schedule(java.util.TimerTask,java.util.Date)>", 1, "void run()"),
    ("<java.util.Timer: void schedule(java.util.TimerTask,long,long)>", 1, "void run()"),
    ("<java.util.Timer: void scheduleAtFixedRate(java.util.TimerTask,long,long)>", 1, "void run()"),
)


def entry_points(components: DataFrame, methods: DataFrame) -> DataFrame:
    """(class, component, method, step): lifecycle methods that components (class, component) implement.

    The template is a literal table of a few dozen rows, so the planner sends it to every task.
    """
    rows = [(kind, name, i) for kind, names in LIFECYCLES.items() for i, name in enumerate(names)]
    template = components.sparkSession.createDataFrame(rows, "component string, name string, step int")
    return components.join(template, "component").join(methods.select("class", "name", F.col("sig").alias("method")), ["class", "name"]).select("class", "component", "method", "step")


def dummy_edges(entries: DataFrame) -> DataFrame:
    """(src, dst): a synthetic main calls one method for each component, which calls the lifecycle methods."""
    main = entries.select(F.lit("dummyMain").alias("src"), F.concat(F.lit("dummyMain_"), "class").alias("dst")).distinct()
    inner = entries.select(F.concat(F.lit("dummyMain_"), "class").alias("src"), F.col("method").alias("dst"))
    return main.unionByName(inner)


def dummy_flow(entries: DataFrame, sequential: bool = True) -> DataFrame:
    """(method, src, dst): control flow in the synthetic method of each component, from 0 over calls step + 1 to -1.

    sequential runs the lifecycle methods once, in order; otherwise any of them may run next, or none, again and again.
    """
    calls = entries.select(F.concat(F.lit("dummyMain_"), "class").alias("method"), (F.col("step") + 1).cast("long").alias("node")).distinct()
    zero, end = F.lit(0).cast("long"), F.lit(-1).cast("long")
    if not sequential:
        nothing = calls.select("method", zero.alias("src"), end.alias("dst")).distinct()
        return calls.select("method", zero.alias("src"), F.col("node").alias("dst")).unionByName(calls.select("method", F.col("node").alias("src"), zero.alias("dst"))).unionByName(nothing)
    order = Window.partitionBy("method").orderBy("node")
    chained = calls.select("method", F.col("node").alias("src"), F.coalesce(F.lead("node").over(order), end).alias("dst"))
    return chained.unionByName(calls.groupBy("method").agg(F.min("node").alias("dst")).select("method", zero.alias("src"), "dst"))


def patched_calls(calls: DataFrame, methods: DataFrame, edges: DataFrame, patches: DataFrame | None = None) -> DataFrame:
    """(call, sub_sig, target): what library methods without a body run of the objects given to them.

    calls are (call, callee, classes), the receiver's class first, then those of the arguments; null classes and
    calls with fewer have none. patches (callee, position, sub_sig) are PATCHES unless given, a few rows that the planner sends to every task.
    """
    if patches is None:
        patches = calls.sparkSession.createDataFrame(PATCHES, "callee string, position int, sub_sig string")
    given = calls.join(patches, "callee").select("call", F.get("classes", F.col("position")).alias("class"), "sub_sig").where("class IS NOT NULL")
    return hierarchy.dispatch(given, methods, edges, outside=True)


def registered_callbacks(invokes: DataFrame, interfaces: DataFrame, methods: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, method) of callbacks: an invoke (component, arg_class) passes an object whose class
    implements a listed interface (name, sub_sig), and the class or one above it has the method."""
    wanted = invokes.join(hierarchy.reflexive(edges).select(F.col("sub").alias("arg_class"), F.col("sup").alias("name")), "arg_class").join(interfaces, "name")
    calls = wanted.select(F.struct("component", "arg_class").alias("call"), F.col("arg_class").alias("class"), "sub_sig").distinct()
    own = calls.join(methods.select("class", "sub_sig", F.col("sig").alias("method")), ["class", "sub_sig"])
    return own.select("call.component", "method").distinct()


def overriding_callbacks(components: DataFrame, methods: DataFrame, edges: DataFrame, framework: DataFrame) -> DataFrame:
    """(component, method): methods of a component that override one of a framework class (class)."""
    found = hierarchy.overridden(methods, edges).join(framework.select(F.col("class").alias("base")), "base", "left_semi")
    return components.select("class").join(found, "class").join(methods.select("class", "sub_sig", F.col("sig").alias("method")), ["class", "sub_sig"]).select(F.col("class").alias("component"), "method").distinct()


def discovered(components: DataFrame, entries: DataFrame, calls: DataFrame, registrations: DataFrame, cap: int = 100) -> DataFrame:
    """(component, method) reachable in each component, callbacks included.

    registrations (method, callback) add a callback once the method that registers it is
    reachable; a component with more than cap callbacks is dropped, as its analysis would be.
    """
    edges = calls.select("src", "dst").unionByName(registrations.select(F.col("method").alias("src"), F.col("callback").alias("dst")))
    edges = checkpointed(edges.distinct())
    start = entries.select(F.col("class").alias("component"), F.col("method").alias("node")).distinct()
    seen = frontier = checkpointed(start)
    while True:
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("component", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(step.join(seen, ["component", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    n = seen.join(registrations.select(F.col("callback").alias("node")).distinct(), "node", "left_semi").groupBy("component").agg(F.count("*").alias("n"))
    return seen.join(n.where(F.col("n") > cap), "component", "left_anti").select("component", F.col("node").alias("method"))


def component_links(sends: DataFrame, components: DataFrame) -> DataFrame:
    """(stmt, src, dst): explicit intents by target, implicit ones by action, to exported components or those of the same package.

    sends: (stmt, src, package, target, action); components: (name, package, exported, actions).
    """
    named = components.select(F.col("name").alias("target")).distinct()
    offered = components.select("name", F.col("package").alias("home"), "exported", F.explode("actions").alias("action"))
    offers = offered.groupBy("action", "name").agg(F.max(F.coalesce("exported", F.lit(False))).alias("exported"), F.collect_set("home").alias("homes"))

    def linked(rows):
        explicit = rows.where("target IS NOT NULL").select("stmt", "src", "target").distinct().join(named, "target").select("stmt", "src", F.col("target").alias("dst"))
        asked = rows.where("target IS NULL").groupBy("stmt", "src", "action").agg(F.collect_set("package").alias("packages"))
        implicit = hierarchy.dealt_join(asked, offers, ["action"], F.struct("stmt", "src")).where("exported OR arrays_overlap(homes, packages)")
        return explicit.unionByName(implicit.select("stmt", "src", F.col("name").alias("dst")))

    # a statement that asks for one thing only has each link once, so those links, which are as many as pairs, are not shuffled to be made distinct
    each = sends.groupBy("stmt", "src").agg(F.collect_set(F.struct("target", "action", "package")).alias("asked"))
    asks = F.size(F.array_distinct(F.transform("asked", lambda x: F.struct(x["target"], F.when(x["target"].isNull(), x["action"])))))
    rows = each.withColumn("asks", asks).select("stmt", "src", "asks", F.explode("asked").alias("x")).select("stmt", "src", "asks", "x.*")
    return linked(rows.where("asks = 1")).unionByName(linked(rows.where("asks > 1")).distinct())


def accessor_edges(edges: DataFrame) -> DataFrame:
    """Calls of synthetic accessors ...$$Nest$m<name> lead to the real method of the class too."""
    real = F.regexp_replace("dst", r"\$\$Nest\$m", "")
    added = edges.where(F.contains("dst", F.lit("$$Nest$m"))).select("src", real.alias("dst"))
    return edges.unionByName(added).distinct()


def listener_edges(edges: DataFrame, registrations: DataFrame, methods: DataFrame, name: str = "onClick") -> DataFrame:
    """Adds (registering method, handler) for registrations (method, listener_class), lambdas given by their body method."""
    handlers = methods.where(F.col("name").startswith(name) | F.col("name").startswith("lambda$")).select(F.col("class").alias("listener_class"), F.col("sig").alias("dst")).distinct()
    registered = registrations.select(F.col("method").alias("src"), "listener_class").distinct()
    # a handler of one class comes once for each method, so these pairs are not shuffled to be made distinct; edges that are such pairs are taken out of the edges
    classes = handlers.groupBy("dst").agg(F.collect_set("listener_class").alias("classes"))
    added = lambda where: hierarchy.dealt_join(registered, classes.where(where).select("dst", F.explode("classes").alias("listener_class")), ["listener_class"], F.col("src")).select("src", "dst")
    known = edges.select("src", "dst").distinct()
    again = known.join(handlers, "dst").join(registered, ["src", "listener_class"], "left_semi").select("src", "dst").distinct()
    return known.join(again, ["src", "dst"], "left_anti").unionByName(added("size(classes) = 1")).unionByName(added("size(classes) > 1").distinct())


def side_effects(calls: DataFrame, direct: DataFrame) -> DataFrame:
    """(method): those that have an effect (method) themselves or through methods they call."""
    return recursion.reachable(recursion.reversed_edges(calls), direct.select(F.col("method").alias("node"))).select(F.col("node").alias("method"))


def static_uses(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """(method, field): static fields that a method reads itself or through methods it calls."""
    seen = frontier = checkpointed(uses.select("method", "field").distinct())
    calls = checkpointed(calls.select("src", "dst").distinct())
    while True:
        step = frontier.join(calls, frontier["method"] == calls["dst"]).select(F.col("src").alias("method"), "field").distinct()
        frontier = checkpointed(step.join(seen, ["method", "field"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def may_alias(points_to: DataFrame) -> DataFrame:
    """(method, a, b): variables of a method whose sets of objects (method, var, obj) meet."""
    one = points_to.select("method", F.col("var").alias("a"), "obj")
    two = points_to.select("method", F.col("var").alias("b"), "obj")
    return one.join(two, ["method", "obj"]).where("a < b").select("method", "a", "b").distinct()


def constants(stmts: DataFrame) -> DataFrame:
    """The constant that a variable holds at each statement: the nearest earlier assignment in textual order.

    stmts: (method, ordinal, lhs, value); an assignment of anything else has a null value and ends it.
    """
    before = Window.partitionBy("method", "lhs").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return stmts.withColumn("known", F.last(F.struct("value")).over(before)["value"])


def list_sizes(ops: DataFrame) -> DataFrame:
    """Size of each list before each operation (method, var, ordinal, op): additions minus removals since it was made or cleared."""
    order = Window.partitionBy("method", "var").orderBy("ordinal")
    age = F.sum(F.when(F.col("op").isin("new", "clear"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    change = F.when(F.col("op") == "add", 1).when(F.col("op") == "remove", -1).otherwise(0)
    rows = ops.withColumn("age", age).withColumn("change", change)
    within = Window.partitionBy("method", "var", "age").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("size", F.coalesce(F.sum("change").over(within), F.lit(0)).cast("int")).drop("age", "change")


def own_callbacks(callbacks: DataFrame, classes: DataFrame, fragments: DataFrame, below: DataFrame) -> DataFrame:
    """Callbacks (component, class, name, of_application) that belong to their component.

    classes: (class, kind, is_component, outers, needs, listens, constructed): enclosing classes, classes that a
    constructor takes, whether it listens to the whole application, and whether a constructor is reachable.
    fragments: (fragment, activity); below: (sub, sup), a class being below itself.

    A fragment stays only with its own activities. A handler that is another component, lies within one or
    is built from one goes. An application hosts only what listens to it, other components none of its
    callbacks. A handler needs a reachable constructor, but for the component itself, classes above it or
    within it, and fragments.
    """
    parts = classes.where("is_component").select("class")
    hosts = classes.select(F.col("class").alias("component"), F.col("kind").alias("host"))
    own = fragments.select(F.col("fragment").alias("class"), F.col("activity").alias("component"), F.lit(True).alias("listed")).distinct()
    up = below.select(F.col("sub").alias("component"), F.col("sup").alias("class"), F.lit(True).alias("above")).distinct()
    pairs = callbacks.select("component", "class").distinct().join(classes, "class")
    outer = pairs.select("component", "class", F.explode("outers").alias("outer")).join(parts.withColumnRenamed("class", "outer"), "outer", "left_semi")
    alien = outer.join(below.select(F.col("sub").alias("component"), F.col("sup").alias("outer")), ["component", "outer"], "left_anti").select("component", "class")
    taken = pairs.select("component", "class", F.explode("needs").alias("need")).where("need <> component").join(parts.withColumnRenamed("class", "need"), "need", "left_semi").select("component", "class")
    pairs = pairs.join(alien.unionByName(taken).distinct(), ["component", "class"], "left_anti").join(hosts, "component").join(own, ["component", "class"], "left").join(up, ["component", "class"], "left")
    same, fragment = F.col("component") == F.col("class"), F.col("kind") == "Fragment"
    at_home = ~fragment | ((F.col("host") == "Activity") & F.col("listed").isNotNull())
    heard = (F.col("host") != "Application") | same | F.col("listens")
    built = F.col("constructed") | fragment | F.col("above").isNotNull() | F.array_contains("outers", F.col("component"))
    kept = pairs.where(at_home & (same | ~F.col("is_component")) & heard & built).select("component", "class", "host")
    return callbacks.join(kept, ["component", "class"]).where("host = 'Application' OR NOT of_application").select("component", "class", "name").distinct()


def control_sources(lookups: DataFrame, controls: DataFrame, mode: str = "sensitive") -> DataFrame:
    """Lookups (method, stmt, control_id) whose value is a source: those of no control, of all, or of sensitive ones (id, view, sensitive).

    A control that several layouts declare is sensitive where one of them says so.
    """
    if mode not in ("none", "all", "sensitive"):
        raise ValueError(f"unknown mode {mode}")
    wanted = controls.where(F.lit(mode == "all") | (F.lit(mode == "sensitive") & F.col("sensitive")))
    return lookups.join(wanted.select(F.col("id").alias("control_id")).distinct(), "control_id", "left_semi").select("method", "stmt", "control_id")


def concatenations(calls: DataFrame) -> DataFrame:
    """(call, step, kind, value): builder calls that a dynamically invoked concatenation stands for.

    calls: (call, recipe, args, constants). A recipe holds literal text, \\u0001 for the next argument and \\u0002 for
    the next constant; the builder is made first, and its text is taken last.
    """
    parts = F.filter(F.regexp_extract_all("recipe", F.lit("(\u0001|\u0002|[^\u0001\u0002]+)"), 1), lambda x: x != "")
    nth = lambda x, i, mark: F.size(F.filter(F.slice(F.col("parts"), F.lit(1), i + 1), lambda y: y == mark))
    made = F.transform(
        "parts",
        lambda x, i: F.when(x == "\u0001", F.struct(F.lit("append").alias("kind"), F.try_element_at("args", nth(x, i, "\u0001")).alias("value")))
        .when(x == "\u0002", F.struct(F.lit("append_constant").alias("kind"), F.try_element_at("constants", nth(x, i, "\u0002")).alias("value")))
        .otherwise(F.struct(F.lit("append_constant").alias("kind"), x.alias("value"))),
    )
    none = F.lit(None).cast("string").alias("value")
    steps = F.concat(F.array(F.struct(F.lit("new").alias("kind"), none)), made, F.array(F.struct(F.lit("text").alias("kind"), none)))
    return calls.withColumn("parts", parts).select("call", F.posexplode(steps).alias("step", "s")).select("call", "step", "s.kind", "s.value")
