"""Scalar functions on signatures, conditions and responses, as column expressions.

Everything here stays inside whole-stage code generation; there are no Python UDFs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered rules from words in a lower-cased entry signature to its path type.
PATH_TYPES = (
    ("activity_lifecycle", ("oncreate", "onstart", "onresume")),
    ("user_interaction", ("onclick", "ontouch", "onkey")),
    ("service_lifecycle", ("onstartcommand", "onbind")),
    ("broadcast_receiver", ("onreceive",)),
    ("background_thread", ("run", "doinbackground")),
    ("menu_interaction", ("onoptionsitemselected", "onmenuitemclick")),
)
# Words that make a method's name interesting.
INTERESTING = ("click", "save", "delete", "update", "menu", "button", "touch", "submit", "send", "create")
# Comparison words of the intermediate language and their symbols.
COMPARISONS = ((" gt ", " > "), (" lt ", " < "), (" ge ", " >= "), (" le ", " <= "), (" eq ", " == "), (" ne ", " != "))
# Component words in simple class names.
COMPONENTS = ("Activity", "Fragment", "Service", "Worker", "Receiver", "Dialog")
# Lifecycle callbacks.
LIFECYCLE = (
    "onCreate", "onStart", "onResume", "onPause", "onStop", "onDestroy", "onCreateView", "onViewCreated", "onDestroyView", "onStartCommand", "onBind", "onUnbind", "onReceive", "doWork",
)
# Beginnings of class names that a call graph leaves out as not of the app.
NOT_OF_APP = ("java.", "javax.", "android.", "androidx.", "com.google.", "org.apache.")
# Beginnings of packages of the platform and of common libraries.
FRAMEWORK = (
    "android.", "com.android.", "java.", "javax.", "com.google.android.", "com.facebook.", "com.paypal.", "ly.kite.", "io.card.", "com.stripe.", "com.crashlytics.", "com.appsflyer.",
)
# Beginnings of class names of the system.
SYSTEM = ("android.", "java.", "javax.", "sun.", "org.omg.", "org.w3c.dom.", "com.google.", "com.android.")
# Component of each base class of the platform.
COMPONENT_OF = {
    "android.app.Activity": "Activity", "androidx.appcompat.app.AppCompatActivity": "Activity", "androidx.fragment.app.Fragment": "Fragment", "android.app.Fragment": "Fragment",
    "androidx.fragment.app.DialogFragment": "Fragment", "android.app.Service": "Service", "androidx.work.Worker": "Worker", "android.content.BroadcastReceiver": "Receiver",
    "android.app.Dialog": "Dialog", "androidx.appcompat.app.AlertDialog": "Dialog",
}
# Severities from worst to least.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM")

_SIGNATURE = r"^<([^:]+): (\S+) ([^(\s]+)\(([^)]*)\)>$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group, null where the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def signature(sig) -> Column:
    """<class: ret name(p1,p2)> as a struct of class, ret, name and params; null fields where it isn't one."""
    c = _col(sig)
    inside = _first(c, _SIGNATURE, 4)
    params = F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, r"\s*,\s*"))
    return F.struct(_first(c, _SIGNATURE, 1).alias("class"), _first(c, _SIGNATURE, 2).alias("ret"), _first(c, _SIGNATURE, 3).alias("name"), params.alias("params"))


def sub_signature(sig) -> Column:
    return _first(_col(sig), r"^<[^:]+: (.*)>$")


def method_name(sig) -> Column:
    """Text between the last space before the parenthesis and the parenthesis; a hash-based name otherwise."""
    c = _col(sig)
    return F.coalesce(_first(c, r"([^\s(]+)\("), F.concat(F.lit("method_"), F.abs(F.xxhash64(c)).cast("string")))


def path_type(sig) -> Column:
    c = F.lower(_col(sig))
    out = F.when(c.isNull(), "unknown")
    for name, words in PATH_TYPES:
        out = out.when(reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words)), name)
    return out.otherwise("application_method")


def path_kind(class_name, name) -> Column:
    """Path type from the names of class and method, by ordered rules."""
    c, m = _col(class_name), _col(name)
    has = F.contains
    return (
        F.when(m.isNull(), "OTHER")
        .when(has(m, F.lit("onCreate")) | has(m, F.lit("onStart")) | has(m, F.lit("onResume")), "ACTIVITY_LIFECYCLE")
        .when(has(c, F.lit("Service")), "SERVICE_LIFECYCLE").when(has(c, F.lit("Receiver")), "BROADCAST_RECEIVER").when(has(c, F.lit("Provider")), "CONTENT_PROVIDER")
        .when(has(m, F.lit("onClick")) | has(m, F.lit("onTouch")), "USER_INTERACTION")
        .when(has(m, F.lit("run")) | has(c, F.lit("Thread")), "THREAD_EXECUTION").otherwise("OTHER")
    )


def lifecycle(name) -> Column:
    return F.when(_col(name).isin(*LIFECYCLE), _col(name))


def component_label(simple_name) -> Column:
    c = _col(simple_name)
    return F.coalesce(*(F.when(F.contains(c, F.lit(w)), w) for w in COMPONENTS), F.lit("Object"))


def interesting(name) -> Column:
    return F.lower(_col(name)).rlike("|".join(INTERESTING))


def likely_entry(name, component) -> Column:
    """Not a constructor; named on...; for providers also the four data operations."""
    n = _col(name)
    data = (_col(component) == "ContentProvider") & n.isin("query", "insert", "update", "delete")
    return ~n.isin("<init>", "<clinit>") & (n.startswith("on") | data)


def begins(c, prefixes) -> Column:
    """Whether a name begins with one of the prefixes."""
    return reduce(lambda a, b: a | b, (F.startswith(_col(c), F.lit(p)) for p in prefixes), F.lit(False))


def app_specific(class_name) -> Column:
    return ~begins(class_name, NOT_OF_APP)


def framework_package(package) -> Column:
    return begins(package, FRAMEWORK)


def system_class(class_name) -> Column:
    return begins(class_name, SYSTEM)


def unseen_by_wrappers(class_name, name) -> Column:
    """Calls that the skip rule lets no taint into: construction of plain objects and threads, class initialisers of objects, getClass."""
    c, n = _col(class_name), _col(name)
    return ((c == "java.lang.Object") & n.isin("<init>", "<clinit>", "getClass")) | ((c == "java.lang.Thread") & (n == "<init>"))


def labelled_component(class_name, above) -> Column:
    """Component of a class by its own name, else by the names of the classes above it, else by words in its name."""
    pairs = F.create_map(*(F.lit(x) for pair in COMPONENT_OF.items() for x in pair))
    up = F.filter(F.transform(_col(above), lambda x: F.try_element_at(pairs, x)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(pairs, _col(class_name)), F.try_element_at(up, F.lit(1)), component_label(class_name))


def root_package(class_name) -> Column:
    return F.substring_index(_col(class_name), ".", 2)


def severity_rank(severity) -> Column:
    c = _col(severity)
    return F.coalesce(*(F.when(c == s, F.lit(i)) for i, s in enumerate(SEVERITIES)))


def fallback_condition(condition, branch) -> Column:
    """[c] or [!(c)] with readable variables and comparison symbols."""
    c = F.replace(_col(condition), F.lit("$"), F.lit("var_"))
    for word, symbol in COMPARISONS:
        c = F.replace(c, F.lit(word), F.lit(symbol))
    return F.when(_col(branch), F.concat(F.lit("["), c, F.lit("]"))).otherwise(F.concat(F.lit("[!("), c, F.lit(")]")))


def fallback_switch(case_value, is_default) -> Column:
    return F.when(_col(is_default), F.lit("[switch_var == default]")).otherwise(F.concat(F.lit("[switch_var == "), _col(case_value), F.lit("]")))


def fallback_variable(type_name, variable) -> Column:
    t, v = _col(type_name), F.replace(_col(variable), F.lit("$"), F.lit("var_"))
    suffix = F.when(F.contains(t, F.lit("boolean")), "_bool").when(F.contains(t, F.lit("int")), "_int").when(F.contains(t, F.lit("String")), "_string").otherwise("")
    return F.concat(v, suffix)


def fallback_parameter(parameter, index) -> Column:
    p = _col(parameter)
    return F.when(~p.rlike(r"^\$[ir]\d+$"), F.concat(F.lit("param["), _col(index).cast("string"), F.lit("] = "), F.replace(p, F.lit("$"), F.lit("var_"))))


_CONDITION = r"([\w.]+)\s*(==|!=|>=|<=|>|<)\s*(\w+)"


def condition(text, raw) -> Column:
    """variable, operator and value of a condition; words of the raw form, then unknowns, as fallbacks."""
    t, r = _col(text), _col(raw)
    word = F.coalesce(*(F.when(F.contains(r, F.lit(f" {w} ")), f" {w} ") for w in ("gt", "eq", "ne")))
    symbol = F.when(word == " gt ", ">").when(word == " eq ", "==").when(word == " ne ", "!=")

    def part(group, fallback):
        return F.coalesce(_first(t, _CONDITION, group), fallback, F.lit("unknown"))

    left = F.when(word.isNotNull(), F.trim(F.call_function("substring_index", r, word, F.lit(1))))
    right = F.when(word.isNotNull(), F.trim(F.element_at(F.call_function("split", r, word), 2)))
    return F.struct(part(1, left).alias("variable"), part(2, symbol).alias("operator"), part(3, right).alias("value"))


def switch_variable(text) -> Column:
    return F.coalesce(_first(_col(text), r"([\w.]+)\s*=="), F.lit("switch_var"))


def between(text, start: str, end: str) -> Column:
    """Trimmed text between two markers; null if either is missing."""
    return F.trim(_first(_col(text), rf"(?s)\Q{start}\E(.*?)\Q{end}\E"), F.lit(" \t\r\n"))


def structured_response(text) -> Column:
    """Branch direction and the three formats, each filled from another where empty."""
    c = _col(text)
    f1, f2, f3 = (F.nullif(between(c, f"{m}_CONSTRAINT_START", f"{m}_CONSTRAINT_END"), F.lit("")) for m in ("BOOLEAN", "BUSINESS", "TECHNICAL"))
    first = F.coalesce(f1, f2, F.lit("unknown_condition"))
    made = F.struct(
        (F.upper(between(c, "BRANCH_DIRECTION_START", "BRANCH_DIRECTION_END")) == "TRUE").alias("branch"),
        first.alias("format1"), F.coalesce(f2, first).alias("format2"), F.coalesce(f3, first).alias("format3"),
    )
    return F.when(F.trim(c) != "", made)


def clean_response(text) -> Column:
    """The first useful line of a free answer without prefixes, quotes, brackets and asides."""
    c = F.trim(F.coalesce(_col(text), F.lit("")), F.lit(" \t\r\n"))
    c = F.regexp_replace(c, r"^(Response|Answer|Output|Condition|The condition is):?\s*", "")
    c = F.regexp_replace(c, r"^Format \d[^:]*:\s*", "")
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: (x != "") & ~x.startswith("This") & ~x.startswith("In this"))
    c = F.coalesce(F.try_element_at(lines, F.lit(1)), c)
    c = F.regexp_replace(c, r"^[\"\[]+|[\"\]]+$", "")
    return F.trim(F.regexp_replace(c, r"\s*\(.*?\)\s*", ""), F.lit(" \t\r\n"))


def truncated(text, length: int) -> Column:
    c = _col(text)
    over = F.length(c) - length
    return F.when(c.isNull(), "null").when(over <= 0, c).otherwise(F.concat(F.substring(c, 1, length), F.lit("... [+"), over.cast("string"), F.lit(" chars]")))


def joined(parts, word: str) -> Column:
    """'' for none, the part itself for one, (a) WORD (b) for more."""
    c = _col(parts)
    many = F.array_join(F.transform(c, lambda x: F.concat(F.lit("("), x, F.lit(")"))), f" {word} ")
    return F.when(F.size(c) == 0, "").when(F.size(c) == 1, F.element_at(c, 1)).otherwise(many)


def branch_expression(text, branch) -> Column:
    return F.when(_col(branch), _col(text)).otherwise(F.concat(F.lit("!("), _col(text), F.lit(")")))


def cosine(a, b) -> Column:
    """Cosine similarity of two arrays; 0 where a norm is 0."""
    x, y = _col(a), _col(b)

    def dot(p, q):
        return F.aggregate(F.zip_with(p, q, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm == 0, 0.0).otherwise(dot(x, y) / norm)


def json_escaped(text) -> Column:
    c = F.replace(_col(text), F.lit("\\"), F.lit("\\\\"))
    for raw, safe in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def csv_escaped(text) -> Column:
    c = _col(text)
    return F.when(c.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def xml_escaped(text) -> Column:
    c = _col(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def file_name(text) -> Column:
    """A name that every file system takes, cut to 100 characters for display."""
    return F.substring(safe_name(text), 1, 100)


def safe_name(text) -> Column:
    """The name in full, with characters that a file system may refuse replaced."""
    return F.regexp_replace(_col(text), r"[^A-Za-z0-9._-]", "_")


def length_bucket(n) -> Column:
    c = _col(n)
    return F.when(c <= 5, "1-5").when(c <= 10, "6-10").when(c <= 20, "11-20").otherwise("20+")


def resource_names(text) -> Column:
    """Names of R.layout, R.string and R.id references."""
    return F.array_distinct(F.regexp_extract_all(_col(text), F.lit(r"R\.(?:layout|string|id)\.(\w+)"), 1))


def routes(text) -> Column:
    """route: plus each quoted string of 2 to 99 characters with a slash."""
    found = F.filter(F.regexp_extract_all(_col(text), F.lit(r'"([^"]*)"'), 1), lambda x: F.contains(x, F.lit("/")) & F.length(x).between(2, 99))
    return F.transform(found, lambda x: F.concat(F.lit("route:"), x))


def bundle_type(method) -> Column:
    """Type that a put... method of a bundle stores."""
    name = F.regexp_extract(_col(method), r"^put(\w+)$", 1)
    return F.when(name == "Extra", "Object").when(name != "", name)


def chain_summary(path_type, reachable, methods) -> Column:
    """A readable block of a call chain; a fixed line where there is none."""
    m = _col(methods)
    steps = F.array_join(F.transform(m, lambda x, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), "")
    head = F.concat(F.lit("Path Type: "), _col(path_type), F.lit("\nReachable: "), _col(reachable).cast("string"), F.lit("\nCall Chain ("), F.size(m).cast("string"), F.lit(" methods):\n"))
    return F.when(m.isNull() | (F.size(m) == 0), "No call chain available").otherwise(F.concat(head, steps))


def unreachable_chain(sig) -> Column:
    """The chain of a method that nothing leads to."""
    return F.array(F.lit("NoPathFound"), _col(sig))


def framework_info(section) -> Column:
    """Framework method and return type named in a section of variables."""
    found = lambda word: _first(_col(section), rf"(?i){word}:\s*(.+?)(?=\n|$)")
    method, kind = F.trim(found("Framework Method")), F.trim(found("Return Type"))
    made = F.concat_ws("; ", F.concat(F.lit("Framework method: "), method), F.concat(F.lit("Returns: "), kind))
    return F.when(made == "", "Technical condition analysis").otherwise(made)


def boolean_format(section, business) -> Column:
    """A plain comparison of the first variable of a section, else the business text."""
    name = F.trim(_first(_col(section), r"(?i)Variable:\s*(.+?)(?=\n|$)"))
    return F.coalesce(F.concat(name, F.lit(" == condition_value")), _col(business), F.lit("condition_check"))


def stable_id(kind: str, *parts) -> Column:
    """An id that depends on the parts alone."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat_ws("|", *(_col(p) for p in parts)), 256), 1, 16))


def base_values(kind, operands, keep_array: bool = False) -> Column:
    """The values that a taint of an expression rests on: both sides of a binary one, else its operand without casts and the like.

    kind is array, cast, new_array, instance_of, unary, binary or plain; operands are in order, an array's base first.
    """
    k, o = _col(kind), _col(operands)
    inner = k.isin("cast", "new_array", "instance_of", "unary", *([] if keep_array else ["array"]))
    whole = F.array_join(o, ",")
    return F.when(k == "binary", F.slice(o, 1, 2)).when(inner, F.slice(o, 1, 1)).otherwise(F.array(whole))
