"""Text functions of one Column: tokens, query classes, path signals. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a file.
PATH_STOPWORDS = "how the for of in on at to is are and or what where when why".split()
#: A query with one of these words wants tests or examples, so their paths aren't penalised.
PENALTY_OFF = "test tests spec specs benchmark benchmarks bench example examples demo".split()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_camel(x) -> Column:
    """lowerUpper and UPPERLower boundaries become underscores; OAuth stays whole."""
    x = F.regexp_replace(_c(x), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(x, r"([A-Z]{2,})([A-Z][a-z])", "$1_$2")


def parts(run) -> Column:
    """Lower-case parts of an identifier that split_camel has been over."""
    return F.filter(F.split(F.lower(_c(run)), "_"), lambda p: p != "")


def _of_run(run: Column) -> Column:
    """Most identifiers have one part, and only the others need the expressions below."""
    return F.when(F.contains(run, F.lit("_")), _of_parts(run)).otherwise(F.array(F.lower(run)))


def _of_parts(run: Column) -> Column:
    sub = parts(run)
    pairs = F.when(F.size(sub) > 1, F.transform(F.sequence(F.lit(1), F.size(sub) - 1), lambda i: F.concat(F.element_at(sub, i), F.lit("_"), F.element_at(sub, i + 1))))
    whole = F.when(F.size(sub) > 1, F.array(F.array_join(sub, "")))
    none = F.array().cast("array<string>")
    return F.concat(sub, F.coalesce(whole, none), F.coalesce(pairs, none))


def tokens(text) -> Column:
    """Tokens of code or prose: of each identifier its parts, and if there are several, the parts joined and each neighbouring
    pair. Repeats are kept."""
    runs = F.regexp_extract_all(split_camel(F.coalesce(_c(text), F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)
    return F.flatten(F.transform(runs, _of_run))


def expansion(text) -> Column:
    """Distinct parts, sorted, of the identifiers of four or more characters that have several."""
    runs = F.regexp_extract_all(_c(text), F.lit(r"([\p{L}\p{N}_]{4,})"), 1)
    several = F.filter(F.transform(runs, lambda r: parts(split_camel(r))), lambda p: F.size(p) > 1)
    return F.array_join(F.array_sort(F.array_distinct(F.flatten(several))), " ")


def query_tokens(text) -> Column:
    """For path signals: tokens without pairs and stopwords, in order of first occurrence."""
    return F.array_distinct(F.filter(tokens(text), lambda t: ~F.contains(t, F.lit("_")) & ~t.isin(PATH_STOPWORDS)))


def identifier_like(token) -> Column:
    t = _c(token)
    return F.coalesce(
        t.rlike(r"[\p{L}\p{N}]")
        & (
            (F.contains(t, F.lit("_")) & (F.length(t) > 1))
            | (F.contains(t, F.lit(".")) & ~t.rlike(r"^\.|\.$|\.\."))
            | F.contains(t, F.lit("::"))
            | t.rlike(r"[a-z][A-Z]")
            | t.rlike(r"^[A-Z0-9_]{2,}$")
        ),
        F.lit(False),
    )


def words(text) -> Column:
    return F.filter(F.split(F.trim(F.coalesce(_c(text), F.lit(""))), r"\s+"), lambda w: w != "")


def query_type(text) -> Column:
    """identifier, keyword, semantic or mixed."""
    w = words(text)
    n, like = F.size(w), F.size(F.filter(w, identifier_like))
    return (
        F.when(n == 0, "keyword").when(n == 1, F.when(like == 1, "identifier").otherwise("keyword")).when(like == n, "identifier")
        .when(n == 2, F.when(like > 0, "mixed").otherwise("keyword")).when(like == 0, "semantic").when(like * 2 >= n, "mixed").otherwise("semantic")
    )


def any_of(text, phrases) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(_c(text), F.lit(p)) for p in phrases))


#: Phrases that ask for everything there is (adaptive cut) and for all that refers to something (graph preset).
EXHAUSTIVE = ("find all", "list all", "all places", "all patterns", "all ways", "all instances", "all cases", "every ", "each ", "enumerate", "exhaustive", "complete list", "anywhere ", "throughout")
EXHAUSTIVE_GRAPH = (
    "all usages", "all callers", "all references", "all places", "all the places", "every place", "every usage", "every caller", "everywhere", "find all", "list all", "all occurrences",
)
#: Words of questions about how things hang together.
ARCHITECTURAL = "flow|lifecycle|pipeline|end to end|e2e|architecture|through|across|from|layers|how does|how do|full|entire|complete|manage".split("|")
PLANNING = ("if i want to add", "if i wanted to add", "how do i add")


def exhaustive(text) -> Column:
    return any_of(F.lower(_c(text)), EXHAUSTIVE)


def exhaustive_graph(text) -> Column:
    return any_of(F.lower(_c(text)), EXHAUSTIVE_GRAPH)


def feature_planning(text) -> Column:
    t = F.lower(_c(text))
    return any_of(t, PLANNING) | t.rlike(r"what files would[\s\S]{0,80}(change|need|touched|update)")


def architectural(text) -> Column:
    return (query_type(text) == "semantic") & (F.size(words(text)) >= 4) & any_of(F.lower(_c(text)), ARCHITECTURAL)


def graph_preset(text) -> Column:
    return F.when(exhaustive_graph(text) | feature_planning(text), "localization").when(architectural(text), "architectural").otherwise(query_type(text))


#: The phrases of the route rules, each of which is looked for anywhere in the query in lower case.
ARCHITECTURE = (
    "main components", "main component", "primary components", "key components", "core components", "main modules", "primary subsystems", "key subsystems", "architecture overview",
    "architectural overview", "system architecture", "high-level architecture", "high level architecture", "god nodes", "god node", "entry points", "primary data flow", "how do they interact",
    "how do these interact", "overall structure", "overall organization", "project structure", "code organization", "main subsystems",
)
STRUCTURAL = ("callers", "callees", "who calls", "what calls", "called by", "used by", "uses", "depends on", "references", "call graph", "type hierarchy", "imports", "imported by")
ANALYTICAL = (
    "most ", "least ", "biggest", "smallest", "longest", "shortest", "complex", "complicated", "important", "critical", "dangerous", "risky", "review", "assess", "evaluate", "analyze", "compare",
    "difference", "versus", " vs ",
)
LISTING = ("list all", "list every", "find all", "find every", "show all", "show every", "what are all", "where are all", "enumerate ")
REGEX_INTENT = ("lines containing", "lines with ", "lines that match", "lines matching", "grep for ", "search for the string ", "occurrences of ")
USAGE = ("where is", "where are", "call ", "calls ", "called", "invoke", "usage of")
#: How a query begins for these rules.
DEEP = ("how ", "why ", "explain ", "describe ", "walk me through ", "what is the flow ", "trace the ")
UNDERSTANDING = ("what does ", "what do ", "what is ", "what are ")


def wrapped(text) -> Column:
    """Whether a text stands in quotes of one kind."""
    return F.trim(_c(text)).rlike(r"^(`[\s\S]*`|\"[\s\S]*\"|'[\s\S]*')$")


def is_regex(text) -> Column:
    """A character class or word boundary by backslash, an alternative outside quotes, brackets, a group with an operator, or an anchor."""
    t = _c(text)
    group = F.regexp_extract(t, r"^[^(]*\(([^)]*)\)", 1)
    return t.rlike(r"\\[bBdDsSwW]") | (~wrapped(t) & F.contains(t, F.lit("|"))) | t.rlike(r"^[^\[]*\[[\s\S]*\]") | group.rlike(r"[|?*+]") | t.rlike(r"^\^|\$\z")


def symbol_shaped(word) -> Column:
    """camelCase, capitals before a lower-case letter (XMLParser), or three characters and more with an underscore or a dot."""
    w = _c(word)
    return w.rlike(r"\p{Ll}\p{Lu}") | (w.rlike(r"^[A-Z]{2,}[^A-Z].*\p{Ll}|^[A-Z]{2,}\p{Ll}") & (F.length(w) >= 3)) | (w.rlike(r"[_.]") & (F.length(w) > 2))


def distinctive(word) -> Column:
    """A word of a question that names code: it is shaped like a symbol, or is written as a call."""
    bare = F.regexp_replace(_c(word), r"^[^\p{L}\p{N}_.]+|[^\p{L}\p{N}_.]+$", "")
    return _c(word).rlike(r"^[\p{L}_.][\p{L}\p{N}_.]+\($") | ((F.length(bare) >= 3) & symbol_shaped(bare))


def _begins(t: Column, phrases) -> Column:
    return reduce(lambda a, b: a | b, (F.startswith(t, F.lit(p)) for p in phrases))


def route(text) -> Column:
    """The route of an agent's query, by ordered rules: file_pattern, regex, exact_symbol, architecture, feature_planning, structural, deep,
    analytical, exhaustive, and for what is left regex or a lookup of a symbol that it names, else semantic."""
    q = F.coalesce(_c(text), F.lit(""))
    t, w = F.lower(q), words(q)
    n, single = F.size(w), F.trim(q)
    inner = F.when(wrapped(single) & (F.length(single) > 1), F.substr(single, F.lit(2), F.length(single) - 2)).otherwise(single)
    symbol = (inner != "") & ~inner.rlike(r"\s") & ((wrapped(single) & (F.length(single) > 1)) | symbol_shaped(inner))
    named = (n >= 2) & F.exists(w, distinctive) & ~_begins(t, UNDERSTANDING)
    return (
        F.when((n <= 2) & (F.contains(q, F.lit("*")) | q.rlike(r"\S\?\S")), "file_pattern").when(is_regex(q), "regex").when(symbol, "exact_symbol")
        .when(any_of(t, ARCHITECTURE), "architecture").when(feature_planning(q), "feature_planning").when(any_of(t, STRUCTURAL), "structural").when(_begins(t, DEEP), "deep")
        .when(any_of(t, ANALYTICAL), "analytical").when(any_of(t, LISTING), "exhaustive").when(any_of(t, REGEX_INTENT), "regex")
        .when(named, F.when(any_of(t, USAGE), "structural").otherwise("exact_symbol")).otherwise("semantic")
    )


def penalty_applies(query) -> Column:
    return ~F.lower(_c(query)).rlike("(^|[^a-z0-9])(" + "|".join(PENALTY_OFF) + ")([^a-z0-9]|$)")


def padded(path) -> Column:
    return F.concat(F.lit("/"), F.trim(F.replace(F.lower(_c(path)), F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))


def file_name(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def path_penalty(path) -> Column:
    """0.30 for a test folder, test file, old code and examples each, 0.70 for type declarations, 0.50 for files that only re-export."""
    p, name = padded(path), file_name(F.lower(_c(path)))
    cut = lambda hit, f: F.when(hit, F.lit(f)).otherwise(F.lit(1.0))
    return (
        cut(p.rlike("/(tests|test|__tests__|spec)/"), 0.30)
        * cut(name.rlike(r"[_./-](test|tests|spec|specs|_test|\.spec|\.test)\.[a-z0-9]+$") | name.rlike(r"^(test_|spec_)[a-z0-9_]+\.[a-z0-9]+$"), 0.30)
        * cut(p.rlike("/(compat|legacy|deprecated|polyfill)/"), 0.30)
        * cut(p.rlike("/(examples?|demos?|samples?)/"), 0.30)
        * cut(F.endswith(name, F.lit(".d.ts")), 0.70)
        * cut(name.isin("__init__.py", "mod.rs", "index.ts", "index.js", "package-info.java"), 0.50)
    )


def stem_boost(path, tokens_col) -> Column:
    """0.40 if a query token is the file's stem or one of its parts, 0.20 if one of three or more characters begins it."""
    stem = F.lower(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))
    own = F.array_append(parts(split_camel(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))), stem)
    return F.when(F.arrays_overlap(own, _c(tokens_col)), 0.40).when(F.exists(_c(tokens_col), lambda t: (F.length(t) >= 3) & F.startswith(stem, t)), 0.20).otherwise(0.0)


#: Roles of files by what their path contains, first match first, with their weight in a ranking.
FILE_ROLES = (
    ("service", ("services/", "service/", "/svc/"), 1.15), ("controller", ("controllers/", "controller/", "handlers/", "handler/", "routes/", "router/"), 1.15),
    ("model", ("models/", "model/", "entities/", "entity/", "schemas/", "schema/", "dto/"), 0.85), ("repository", ("repositories/", "repository/", "repos/", "repo/", "dal/", "dao/"), 1.05),
    ("utility", ("utils/", "util/", "helpers/", "helper/", "lib/", "common/"), 1.00), ("config", ("config/", "configuration/", "settings/"), 0.90),
    ("test", ("test/", "tests/", "__tests__/", "spec/", "_test.", ".test.", ".spec."), 0.70), ("migration", ("migrations/", "migration/", "migrate/", "db/migrate/"), 0.80),
    ("middleware", ("middleware/", "interceptor/", "interceptors/", "guard/", "guards/"), 1.10),
    ("documentation", ("docs/", "doc/", "documentation/", "legal/", ".md", "changelog", "license", "readme"), 0.75),
)
IMPORT_ROLES = (("repository", ("orm", "prisma", "typeorm", "sqlalchemy", "diesel")), ("controller", ("express", "fastapi", "actix", "axum", "gin")), ("test", ("jest", "pytest", "mocha")))


def _has(names):
    return lambda x: any_of(F.lower(x), names)


def file_role(path, imports=None) -> Column:
    p = F.lower(_c(path))
    out = reduce(lambda w, r: w.when(any_of(p, r[1]), r[0]), FILE_ROLES[1:], F.when(any_of(p, FILE_ROLES[0][1]), FILE_ROLES[0][0]))
    if imports is not None:
        for role, names in IMPORT_ROLES:
            out = out.when(F.exists(_c(imports), _has(names)), role)
    return out.otherwise("unknown")


def role_weight(role) -> Column:
    return reduce(lambda w, r: w.when(_c(role) == r[0], r[2]), FILE_ROLES[1:], F.when(_c(role) == FILE_ROLES[0][0], FILE_ROLES[0][2])).otherwise(1.0)


def top_dir(path) -> Column:
    return F.when(F.contains(_c(path), F.lit("/")), F.substring_index(_c(path), "/", 1)).otherwise(".")


def parent_dir(path) -> Column:
    return F.when(F.contains(_c(path), F.lit("/")), F.regexp_replace(_c(path), "/[^/]*$", "")).otherwise("")


def extension(path) -> Column:
    return F.coalesce(F.lower(F.nullif(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1), F.lit(""))), F.lit(""))


def strip_module(name) -> Column:
    """What follows the last :: or else the last dot."""
    n = _c(name)
    return F.when(F.contains(n, F.lit("::")), F.substring_index(n, "::", -1)).otherwise(F.substring_index(n, ".", -1))


def first_sentences(text, n: int) -> Column:
    """The text up to its n-th mark. One match from the start that never goes back: what follows isn't read, and a long text without
    a mark is read once, not once from each of its characters."""
    return F.trim(F.regexp_extract(_c(text), rf"^(?:[^.!?]*+[.!?]){{0,{n}}}+", 0))


def regex_words(pattern) -> Column:
    """A pattern's plain words: escapes and metacharacters become blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(pattern), r"\\[a-zA-Z]", " "), r"[\\^$.|?*+()\[\]{}]", " "), r"\s+", " "))


def merge_pattern(query, pattern) -> Column:
    """The query with the pattern's words that it doesn't contain."""
    extra = F.filter(F.split(regex_words(pattern), " "), lambda w: (w != "") & ~F.contains(F.lower(_c(query)), F.lower(w)))
    return F.trim(F.concat_ws(" ", _c(query), F.array_join(extra, " ")))


def keywords(text, stop, most: int = 12) -> Column:
    found = F.regexp_extract_all(F.lower(_c(text)), F.lit(r"([a-z_][a-z0-9_]{2,})"), 1)
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~w.isin(list(stop)))), 1, most)


def branch_key(name) -> Column:
    return F.concat(F.regexp_replace(_c(name), "[^A-Za-z0-9._-]", "_"), F.lit("-"), F.left(F.sha2(_c(name), 256), F.lit(8)))


def tags(tag_array) -> Column:
    clean = F.filter(F.transform(_c(tag_array), lambda t: F.lower(F.trim(t))), lambda t: t != "")
    return F.array_join(F.array_sort(F.array_distinct(clean)), ",")


def signature_line(line) -> Column:
    """Whether a line begins a definition, in the usual languages."""
    return F.trim(_c(line)).rlike(r"^(pub(\([^)]*\))?\s+|export\s+|default\s+|async\s+|static\s+|public\s+|private\s+|protected\s+|abstract\s+|final\s+)*(fn|def|class|func|function|struct|enum|trait|interface|impl|type|module)\b")


def matching_lines(text, terms, most: int = 3) -> Column:
    """The lines with most of the terms, first come first among equals, at most ``most``."""
    lines = F.transform(F.split(_c(text), "\n"), lambda x, i: F.struct((-F.size(F.filter(_c(terms), lambda t: F.contains(F.lower(x), F.lower(t))))).alias("n"), i.alias("i"), x.alias("line")))
    return F.transform(F.slice(F.array_sort(F.filter(lines, lambda s: s["n"] < 0)), 1, most), lambda s: s["line"])


def graph_context(summary) -> Column:
    """struct(calls, called_by) of a summary with "calls a, b" and "called by c" among its parts."""
    part = lambda label: F.filter(F.split(F.regexp_extract(_c(summary), rf"(?:^|; ){label} ([^;]*)", 1), ", "), lambda x: x != "")
    return F.struct(part("calls").alias("calls"), part("called by").alias("called_by"))


def clean_summary(summary) -> Column:
    """A summary without the parts that only the graph needs; null if nothing is left."""
    kept = F.filter(F.split(_c(summary), "; "), lambda p: ~p.rlike("^(calls|called by|params|complexity) ") & (F.trim(p) != ""))
    return F.nullif(F.array_join(kept, "; "), F.lit(""))


def symbol_in(query) -> Column:
    """The symbol that a question is about: what it quotes, else the last of its words that looks like an identifier."""
    quoted = F.regexp_extract(_c(query), "[`\"']([A-Za-z_][\\w.:]*)[`\"']", 1)
    clean = F.transform(words(query), lambda w: F.regexp_replace(w, r"^[^\w]+|[^\w]+$", ""))
    return F.coalesce(F.nullif(quoted, F.lit("")), F.try_element_at(F.filter(clean, identifier_like), F.lit(-1)))


def files_in(formatted) -> Column:
    """Files that a formatted result names, in order."""
    return F.array_distinct(F.regexp_extract_all(_c(formatted), F.lit(r"(?m)^\s*([\w./-]+\.\w+):\d+"), 1))


def truncated(text, most: int) -> Column:
    """struct(text, cut): at most ``most`` characters, and whether any were left out."""
    return F.struct(F.left(_c(text), F.lit(most)).alias("text"), (F.length(_c(text)) > most).alias("cut"))


#: Kinds of definitions that are types; type names that are built in, and those of containers.
TYPE_KINDS = ("class", "struct", "enum", "trait", "interface", "type_alias")
PRIMITIVES = (
    "str", "string", "String", "int", "i8", "i16", "i32", "i64", "i128", "u8", "u16", "u32", "u64", "u128", "f32", "f64", "float", "double", "bool", "boolean", "void", "None", "null", "undefined",
    "number", "usize", "isize", "char", "byte", "self", "Self",
)
CONTAINERS = ("List", "Map", "Vec", "Array", "Set", "Option", "Result", "Optional", "Promise", "Future", "Stream", "Observable", "HashMap", "HashSet", "BTreeMap", "BTreeSet", "Dictionary")
#: Calls that say nothing about a program.
TRIVIAL_CALLS = (
    "push", "pop", "insert", "remove", "get", "set", "len", "is_empty", "contains", "iter", "into_iter", "collect", "extend", "clear", "first", "last", "next", "to_string", "as_str", "to_owned",
    "trim", "split", "join", "starts_with", "ends_with", "replace", "chars", "lines", "format", "write", "writeln", "println", "eprintln", "print", "display", "unwrap", "unwrap_or",
    "unwrap_or_default", "unwrap_or_else", "expect", "ok", "err", "map", "and_then", "or_else", "map_or", "map_or_else", "map_err", "is_some", "is_none", "is_ok", "is_err", "as_ref", "as_deref",
    "into", "from", "try_into", "try_from", "as_mut", "clone", "to_vec", "eq", "ne", "cmp", "partial_cmp", "min", "max", "drop", "take", "swap", "typeof", "instanceof", "log", "debug", "info",
    "warn", "error", "trace",
)


def type_kind(kind) -> Column:
    return _c(kind).isin(*TYPE_KINDS)


def primitive_type(name) -> Column:
    return _c(name).isin(*PRIMITIVES)


def user_type(name) -> Column:
    """A name that isn't built in or a container's, and begins with a capital or has a path before it."""
    n = _c(name)
    return ~n.isin(*PRIMITIVES, *CONTAINERS) & (n.rlike(r"^\p{Lu}") | F.contains(n, F.lit("::")) | F.contains(n, F.lit(".")))


def trivial_call(call) -> Column:
    return F.element_at(F.split(_c(call), "[.:]"), -1).isin(*TRIVIAL_CALLS)


def words_of(identifier) -> Column:
    """An identifier's words, in lower case, with blanks between them."""
    return F.array_join(F.filter(F.split(F.lower(split_camel(F.regexp_replace(_c(identifier), r"[^\p{L}\p{N}]+", "_"))), "_"), lambda w: w != ""), " ")


#: Characters that a query grammar gives a meaning.
GRAMMAR = r"([+\-&|!(){}\[\]^\"~*?:\\/])"


def grammar_escaped(query) -> Column:
    """A backslash before each character of a query grammar, for indexes beyond this engine."""
    return F.regexp_replace(_c(query), GRAMMAR, r"\\$1")


def like_escaped(text) -> Column:
    """For LIKE with a backslash as escape."""
    return F.regexp_replace(_c(text), r"([%_])", r"\\$1")


def match_any(query) -> Column:
    """The query's words in double quotes, joined by OR, for full-text tables; null where it has none."""
    quoted = F.transform(words(query), lambda w: F.concat(F.lit('"'), F.replace(w, F.lit('"'), F.lit('""')), F.lit('"')))
    return F.nullif(F.array_join(quoted, " OR "), F.lit(""))
