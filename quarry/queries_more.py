"""More registered queries, each with its SQL: text and number functions, joins and counts, stages of a ranking, the graph, upkeep.

Where an operator needs names, paths or questions that the tables don't have, they are made of the tables' rows, all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import numbers as N
from quarry.functions import text as T
from quarry.operators import channels as C
from quarry.operators import chunking, cut, evaluate, fusion, graph, imports, maintain, metrics, registry, relational, rescore, store, vectors
from quarry.plans import search as P
from quarry.queries import BM25, CHANNELS, COMMITS, EDGES, IMPORTS, LIKE, ORACLE_SQL, SCORED, TOP20, TYPE_SQL, all_channels, camel, out, query, rounded, scored, sub, toks, types
from quarry.sources import files as FS
from quarry.sources import tables as S
from quarry.sources.shared import new_folder


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values) -> str:
    return ", ".join(quoted(v) for v in values)


def pick(values, key: str) -> Column:
    """One of the values by a row's number."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


def pick_sql(values, key: str) -> str:
    return f"[{listed(values)}][({key} % {len(values)} + 1)::INT]"


def some_of(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(p)})" for p in phrases) + ")"


# ---------------------------------------------------------------- paths and files

ENDINGS = ("py", "rs", "js", "TS", "go", "java", "c", "md", "json", "txt", "unknown", "toml", "d.ts")
PART_PATH_SQL = f"'lib/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || p_partkey || '.' || {pick_sql(ENDINGS, 'p_partkey')}"


def part_paths(spark, sf) -> DataFrame:
    path = F.concat(F.lit("lib/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), "p_partkey", F.lit("."), pick(ENDINGS, "p_partkey"))
    return S.read(spark, sf, "part").withColumn("path", path)


EXT = "lower(regexp_extract(path, '\\.([^.]*)$', 1))"


@query(f"WITH p AS (SELECT p_partkey, {PART_PATH_SQL} AS path FROM part) SELECT p_partkey, CASE {EXT} {' '.join(f'WHEN {quoted(e)} THEN {quoted(t)}' for e, (t, _) in FS.TYPES.items())} ELSE 'unknown' END AS file_type, {EXT} IN ({listed(e for e, (_, d) in FS.TYPES.items() if d)}) AS definitions FROM p")
def file_types(spark, sf):
    return part_paths(spark, sf).select("p_partkey", FS.file_type("path").alias("file_type"), FS.has_definitions("path").alias("definitions"))


@query(f"WITH p AS (SELECT p_partkey, {PART_PATH_SQL} AS path FROM part) SELECT p_partkey FROM p WHERE {EXT} NOT IN ({listed(FS.NOT_CODE)})")
def code_only(spark, sf):
    return part_paths(spark, sf).where(FS.extension_filter("path", None, list(FS.NOT_CODE))).select("p_partkey")


@query(f"WITH p AS (SELECT {PART_PATH_SQL} AS path FROM part) SELECT path FROM p WHERE regexp_matches(path, '^lib/(?:.*/)?[^/]*widget[^/]*\\.rs$') ORDER BY path LIMIT 50")
def glob_listing(spark, sf):
    return FS.glob_files(part_paths(spark, sf), "lib/**/*widget*.rs")[0]


@query("""WITH l AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file_path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line FROM documents)
    SELECT file_path, line, text FROM l WHERE regexp_matches(text, '(?i)licen|token|secret') ORDER BY file_path, line LIMIT 100""")
def lines_matching(spark, sf):
    return FS.lines_matching(S.chunks(spark, sf), "licen token secret")


PATCH = "'--- a/x' || chr(10) || '+++ b/' || event_type || '/f' || (user_id % 97) || '.py' || chr(10) || '@@' || chr(10) || '+++ b/all.py' || chr(10) || '++ no'"


@query(f"SELECT event_id, array_to_string(list_sort(list_distinct(regexp_extract_all({PATCH}, '(?m)^\\+\\+\\+ b/(.+)$', 1))), ',') AS files FROM events")
def patch_files(spark, sf):
    patch = F.concat(F.lit("--- a/x\n+++ b/"), "event_type", F.lit("/f"), (F.col("user_id") % 97).cast("string"), F.lit(".py\n@@\n+++ b/all.py\n++ no"))
    return S.read(spark, sf, "events").select("event_id", F.array_join(FS.changed_files(patch), ",").alias("files"))


# ---------------------------------------------------------------- text functions

IDENT = "p_type || upper(p_name[1]) || replace(p_name[2:], ' ', '')"


def ident() -> Column:
    return F.concat("p_type", F.replace(F.concat(F.upper(F.left("p_name", F.lit(1))), F.substr("p_name", F.lit(2))), F.lit(" "), F.lit("")))


@query(rf"""WITH x AS (SELECT p_partkey, {IDENT} || ' max_retry_count ab ' || p_name AS t FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(flatten(list_filter(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]{{4,}}'), lambda r: {sub(camel('r'))}), lambda p: len(p) > 1)))), ' ') AS words FROM x""")
def identifier_expansion(spark, sf):
    return S.read(spark, sf, "part").select("p_partkey", T.expansion(F.concat(ident(), F.lit(" max_retry_count ab "), "p_name")).alias("words"))


NOT_WORD = "'[^\\p{L}\\p{N}]+', '_', 'g'"


@query(f"SELECT p_partkey, array_to_string(list_filter(string_split(lower({camel(f'regexp_replace({IDENT} || chr(46) || p_brand, {NOT_WORD})')}), '_'), lambda w: w <> ''), ' ') AS words FROM part")
def identifier_words(spark, sf):
    return S.read(spark, sf, "part").select("p_partkey", T.words_of(F.concat(ident(), F.lit("."), "p_brand")).alias("words"))


@query(rf"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter({toks('text')}, lambda t: NOT contains(t, '_') AND t NOT IN ({listed(T.PATH_STOPWORDS)})))), ' ') AS words FROM benchmark")
def path_query_words(spark, sf):
    return S.read(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(T.query_tokens("text")), " ").alias("words"))


RX = r"'\b' || event_type || '(' || props || ')+|x_y'"
RXW = rf"trim(regexp_replace(regexp_replace(regexp_replace({RX}, '\\[a-zA-Z]', ' ', 'g'), '[\\^$.|?*+()\[\]{{}}]', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"SELECT event_id, {RXW} AS words, trim(concat_ws(' ', event_type || ' X_Y', nullif(array_to_string(list_filter(string_split({RXW}, ' '), lambda w: w <> '' AND NOT contains(lower(event_type || ' X_Y'), lower(w))), ' '), ''))) AS merged FROM events")
def regex_to_words(spark, sf):
    pattern, q = F.concat(F.lit(r"\b"), "event_type", F.lit("("), "props", F.lit(")+|x_y")), F.concat("event_type", F.lit(" X_Y"))
    return S.read(spark, sf, "events").select("event_id", T.regex_words(pattern).alias("words"), T.merge_pattern(q, pattern).alias("merged"))


STOP = ("the", "and", "that", "for")


@query(f"""WITH f AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z_][a-z0-9_]{{2,}}'), lambda w: w NOT IN ({listed(STOP)})) AS l FROM benchmark)
    SELECT item_id, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 12), ' ') AS words FROM f""")
def query_keywords(spark, sf):
    return S.read(spark, sf, "benchmark").select("item_id", F.array_join(T.keywords("text", STOP), " ").alias("words"))


HEADS = ("pub(crate) async fn ", "class ", "  def ", "let ", "export default class ", "fnx ", "static public interface ", "impl<T> ", "returns class ")


@query(rf"SELECT p_partkey, regexp_matches(trim({pick_sql(HEADS, 'p_partkey')} || p_name, ' '), '^(pub(\([^)]*\))?\s+|export\s+|default\s+|async\s+|static\s+|public\s+|private\s+|protected\s+|abstract\s+|final\s+)*(fn|def|class|func|function|struct|enum|trait|interface|impl|type|module)\b') AS definition FROM part")
def signature_lines(spark, sf):
    return S.read(spark, sf, "part").select("p_partkey", T.signature_line(F.concat(pick(HEADS, "p_partkey"), "p_name")).alias("definition"))


TERMS = ("the", "erth", "de ", "ción")


@query(f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    n AS (SELECT *, {' + '.join(f'contains(lower(line), {quoted(t)})::INT' for t in TERMS)} AS n FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) AS r FROM n WHERE n > 0)
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY r) FILTER (r <= 3), '') AS lines FROM documents LEFT JOIN r USING (doc_id) GROUP BY 1""")
def best_lines(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", F.array_join(T.matching_lines("text", F.array(*(F.lit(t) for t in TERMS))), "\n").alias("lines"))


SUMMARY_SQL = "'function ' || p_name || '; calls ' || p_type || ', run; called by ' || p_brand || '; complexity ' || p_size || '; Does ' || p_name || '.'"


@query(f"""WITH s AS (SELECT p_partkey, {SUMMARY_SQL} AS s FROM part) SELECT p_partkey, array_to_string(list_filter(string_split(s, '; '), lambda p: NOT regexp_matches(p, '^(calls|called by|params|complexity) ') AND trim(p) <> ''), '; ') AS clean,
    regexp_extract(s, '(?:^|; )calls ([^;]*)', 1) AS calls, regexp_extract(s, '(?:^|; )called by ([^;]*)', 1) AS callers FROM s""")
def summaries(spark, sf):
    s = F.concat(F.lit("function "), "p_name", F.lit("; calls "), "p_type", F.lit(", run; called by "), "p_brand", F.lit("; complexity "), F.col("p_size").cast("string"), F.lit("; Does "), "p_name", F.lit("."))
    x = S.read(spark, sf, "part").withColumn("s", s).withColumn("g", T.graph_context("s"))
    return x.select("p_partkey", T.clean_summary("s").alias("clean"), F.array_join("g.calls", ", ").alias("calls"), F.array_join("g.called_by", ", ").alias("callers"))


ASKED = ("where is `parse_item` used", "who runs getItem now?", "nothing here", "is 'a.b::c' there", "what does max_size do")


@query(rf"""WITH q AS (SELECT p_partkey, {pick_sql(ASKED, 'p_partkey')} || ' ' || p_name AS q FROM part), w AS (SELECT *, list_transform(list_filter(regexp_split_to_array(trim(q, ' '), '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[^\w]+|[^\w]+$', '', 'g')) AS ws FROM q)
    SELECT p_partkey, coalesce(nullif(regexp_extract(q, '[`"'']([A-Za-z_][\w.:]*)[`"'']', 1), ''), list_filter(ws, lambda w: {LIKE})[-1]) AS symbol FROM w""")
def asked_symbols(spark, sf):
    return S.read(spark, sf, "part").select("p_partkey", T.symbol_in(F.concat(pick(ASKED, "p_partkey"), F.lit(" "), "p_name")).alias("symbol"))


@query("SELECT doc_id, left(text, 200) AS text, length(text) > 200 AS cut FROM documents")
def truncations(spark, sf):
    return S.read(spark, sf, "documents").select("doc_id", T.truncated("text", 200).alias("t")).select("doc_id", "t.text", "t.cut")


@query(r"""WITH s AS (SELECT p_partkey, 'src/' || p_type || '.py:3-4  0.1' || chr(10) || '  b/c' || p_size || '.rs:9' || chr(10) || 'src/' || p_type || '.py:7' || chr(10) || 'not one' AS s FROM part)
    SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(s, '(?m)^\s*([\w./-]+\.\w+):\d+', 1))), ',') AS files FROM s""")
def files_named(spark, sf):
    s = F.concat(F.lit("src/"), "p_type", F.lit(".py:3-4  0.1\n  b/c"), F.col("p_size").cast("string"), F.lit(".rs:9\nsrc/"), "p_type", F.lit(".py:7\nnot one"))
    return S.read(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(T.files_in(s)), ",").alias("files"))


@query("SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]', '_', 'g') || '-' || left(sha256(p_name || '/' || p_brand), 8) AS key FROM part")
def branch_keys(spark, sf):
    return S.read(spark, sf, "part").select("p_partkey", T.branch_key(F.concat("p_name", F.lit("/"), "p_brand")).alias("key"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(p_name || ' ,' || p_type || ', ' || p_name || ',', ','), lambda t: lower(trim(t, ' '))), lambda t: t <> ''))), ',') AS tags FROM part")
def note_tags(spark, sf):
    return S.read(spark, sf, "part").select("p_partkey", T.tags(F.split(F.concat("p_name", F.lit(" ,"), "p_type", F.lit(", "), "p_name", F.lit(",")), ",")).alias("tags"))


NAMES = ("Vec", "MyType", "str", "std::io", "a.b", "String", "Option", "lower", "Ünder", "usize", "class", "trait", "fn", "x.push", "fmt::write", "load_item", "unwrap")


@query(f"""WITH n AS (SELECT p_partkey, {pick_sql(NAMES, 'p_partkey')} AS n FROM part) SELECT p_partkey, n IN ({listed(T.TYPE_KINDS)}) AS type_kind, n IN ({listed(T.PRIMITIVES)}) AS primitive,
    n NOT IN ({listed(T.PRIMITIVES + T.CONTAINERS)}) AND (regexp_matches(n, '^\\p{{Lu}}') OR contains(n, '::') OR contains(n, '.')) AS user_type, string_split(replace(n, ':', '.'), '.')[-1] IN ({listed(T.TRIVIAL_CALLS)}) AS trivial FROM n""")
def type_predicates(spark, sf):
    n = S.read(spark, sf, "part").withColumn("n", pick(NAMES, "p_partkey"))
    return n.select("p_partkey", T.type_kind("n").alias("type_kind"), T.primitive_type("n").alias("primitive"), T.user_type("n").alias("user_type"), T.trivial_call("n").alias("trivial"))


@query(rf"""SELECT event_id, regexp_replace(props, '([+\-&|!(){{}}\[\]^"~*?:\\/])', '\\\1', 'g') AS grammar, regexp_replace('50%_' || props, '([%_])', '\\\1', 'g') AS "like",
    nullif(array_to_string(list_transform(list_filter(regexp_split_to_array(trim(props || ' ' || event_type, ' '), '\s+'), lambda w: w <> ''), lambda w: '"' || replace(w, '"', '""') || '"'), ' OR '), '') AS "match" FROM events""")
def query_escapes(spark, sf):
    return S.read(spark, sf, "events").select("event_id", T.grammar_escaped("props").alias("grammar"), T.like_escaped(F.concat(F.lit("50%_"), "props")).alias("like"), T.match_any(F.concat("props", F.lit(" "), "event_type")).alias("match"))


QUESTIONS = (
    "src/*/x.py", "a?b", r"\bword", "left|right", '"left|right"', "list[0]", "(ab+)", "^start", "end$", "getUserById", "XMLParser", "`quoted`", "max_size", "a.b", "the main components of", "entry points", "if i want to add",
    "what files would need a change for", "who calls", "what imports", "how is it with", "explain", "the most complex", "compare", "list all", "enumerate every", "lines containing", "occurrences of", "where is allocItem called",
    "the HandlerFunc type of", "what is getItem", "run abort( with", "authentication and", "every caller of", "tests for", "benchmarks", "end to end flow from the start", "",
)
ASK = f"trim({pick_sql(QUESTIONS, 'p_partkey')} || CASE WHEN p_size % 2 = 0 THEN ' ' || p_name ELSE '' END, ' ')"


def questions(spark, sf) -> DataFrame:
    q = F.trim(F.concat(pick(QUESTIONS, "p_partkey"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_name")).otherwise("")))
    return S.read(spark, sf, "part").select(F.col("p_partkey").alias("query_id"), q.alias("query"))


def _symbol(w: str) -> str:
    return rf"(regexp_matches({w}, '\p{{Ll}}\p{{Lu}}') OR (regexp_matches({w}, '^[A-Z]{{2,}}(\p{{Ll}}|[^A-Z].*\p{{Ll}})') AND length({w}) >= 3) OR (regexp_matches({w}, '[_.]') AND length({w}) > 2))"


BARE = r"regexp_replace(w, '^[^\p{L}\p{N}_.]+|[^\p{L}\p{N}_.]+$', '', 'g')"
WRAPPED = r"""regexp_matches(q, '^(`[\s\S]*`|"[\s\S]*"|''[\s\S]*'')$')"""
ROUTE_SQL = rf"""
    q0 AS (SELECT p_partkey AS query_id, {ASK} AS q FROM part), q1 AS (SELECT *, lower(q) AS l, list_filter(regexp_split_to_array(q, '\s+'), lambda w: w <> '') AS ws, {WRAPPED} AND length(q) > 1 AS wr FROM q0),
    q2 AS (SELECT *, CASE WHEN wr THEN q[2:-2] ELSE q END AS inn FROM q1),
    ro AS (SELECT *, CASE WHEN len(ws) <= 2 AND (contains(q, '*') OR regexp_matches(q, '\S\?\S')) THEN 'file_pattern'
      WHEN regexp_matches(q, '\\[bBdDsSwW]') OR (NOT wr AND contains(q, '|')) OR regexp_matches(q, '^[^\[]*\[[\s\S]*\]') OR regexp_matches(regexp_extract(q, '^[^(]*\(([^)]*)\)', 1), '[|?*+]') OR starts_with(q, '^') OR ends_with(q, '$') THEN 'regex'
      WHEN inn <> '' AND NOT regexp_matches(inn, '\s') AND (wr OR {_symbol('inn')}) THEN 'exact_symbol' WHEN {some_of('l', T.ARCHITECTURE)} THEN 'architecture'
      WHEN contains(l, 'if i want to add') OR contains(l, 'if i wanted to add') OR contains(l, 'how do i add') OR regexp_matches(l, 'what files would[\s\S]{{0,80}}(change|need|touched|update)') THEN 'feature_planning'
      WHEN {some_of('l', T.STRUCTURAL)} THEN 'structural' WHEN {' OR '.join(f'starts_with(l, {quoted(p)})' for p in T.DEEP)} THEN 'deep' WHEN {some_of('l', T.ANALYTICAL)} THEN 'analytical'
      WHEN {some_of('l', T.LISTING)} THEN 'exhaustive' WHEN {some_of('l', T.REGEX_INTENT)} THEN 'regex'
      WHEN len(ws) >= 2 AND len(list_filter(ws, lambda w: regexp_matches(w, '^[\p{{L}}_.][\p{{L}}\p{{N}}_.]+\($') OR (length({BARE}) >= 3 AND {_symbol(BARE)}))) > 0 AND NOT ({' OR '.join(f'starts_with(l, {quoted(p)})' for p in T.UNDERSTANDING)})
      THEN CASE WHEN {some_of('l', T.USAGE)} THEN 'structural' ELSE 'exact_symbol' END ELSE 'semantic' END AS route FROM q2)"""


@query(f"WITH {ROUTE_SQL} SELECT query_id, route FROM ro")
def routes(spark, sf):
    """All ten routes."""
    return questions(spark, sf).select("query_id", T.route("query").alias("route"))


@query(rf"""WITH {ROUTE_SQL}, ty AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: {LIKE})) AS k FROM q2), qt AS (SELECT *, CASE WHEN n = 0 THEN 'keyword' WHEN n = 1 THEN CASE WHEN k = 1 THEN 'identifier' ELSE 'keyword' END WHEN k = n THEN 'identifier'
      WHEN n = 2 THEN CASE WHEN k > 0 THEN 'mixed' ELSE 'keyword' END WHEN k = 0 THEN 'semantic' WHEN k * 2 >= n THEN 'mixed' ELSE 'semantic' END AS query_type FROM ty)
    SELECT query_id, CASE WHEN {some_of('l', T.EXHAUSTIVE_GRAPH)} OR contains(l, 'if i want to add') OR contains(l, 'how do i add') OR regexp_matches(l, 'what files would[\s\S]{{0,80}}(change|need|touched|update)') THEN 'localization'
      WHEN query_type = 'semantic' AND n >= 4 AND {some_of('l', T.ARCHITECTURAL)} THEN 'architectural' ELSE query_type END AS preset,
      NOT regexp_matches(l, '(^|[^a-z0-9])({'|'.join(T.PENALTY_OFF)})([^a-z0-9]|$)') AS penalised FROM qt""")
def graph_presets(spark, sf):
    return questions(spark, sf).select("query_id", T.graph_preset("query").alias("preset"), T.penalty_applies("query").alias("penalised"))


ROLE_NAMES = (
    "sanitize_input", "retryLater", "on_error_x", "beforeRequestHook", "createUser", "from_parts", "shutDownAll", "drop", "drop_it", "verifyToken", "check_size", "decodeFrame", "to_json", "fetchPage", "get_item", "saveAll", "put_x",
    "dispatchEvent", "on_click", "runPipeline", "run", "execute_plan", "plain",
)


def _role_sql() -> str:
    e, n, parts = "words", "lower(name)", []
    for role, words, has, begins in chunking.ROLES:
        hit = [f"contains({e}, {quoted(w)})" for w in words] + [f"contains({n}, {quoted(w)})" for w in has] + [f"starts_with({n}, {quoted(w)})" for w in begins]
        hit += [f"{n} = 'drop'"] * (role == "destructor") + [f"(regexp_matches({n}, '^(run|execute)(_|$)') AND calls >= 3)"] * (role == "orchestrator")
        parts.append(f"WHEN {' OR '.join(hit)} THEN {quoted(role)}")
    return f"CASE {' '.join(parts)} END"


@query(f"""WITH r AS (SELECT p_partkey, {pick_sql(ROLE_NAMES, 'p_partkey')} AS name, p_size % 5 AS calls FROM part), w AS (SELECT *, array_to_string(list_filter(string_split(lower({camel('name')}), '_'), lambda w: w <> ''), ' ') AS words FROM r) SELECT p_partkey, {_role_sql()} AS role FROM w""")
def semantic_roles(spark, sf):
    x = S.read(spark, sf, "part").withColumns({"name": pick(ROLE_NAMES, "p_partkey"), "calls": F.array_repeat(F.lit("f"), (F.col("p_size") % 5).cast("int"))})
    return x.select("p_partkey", chunking.semantic_role("name", "calls").alias("role"))


@query("""SELECT p_partkey, 'Does ' || p_name || '.' || chr(10) || 'purpose: function ' || array_to_string(list_filter(string_split(lower(replace(p_name, ' ', '_')), '_'), lambda w: w <> ''), ' ') || ' — returns ' || p_type || chr(10) || 'role: fetcher' || chr(10) || 'calls: load item' || chr(10) || 'called by: main loop' AS note FROM part""")
def annotations(spark, sf):
    call = F.array(F.lit("x.push"), F.lit("loadItem"))
    note = chunking.annotation(F.concat(F.lit("Does "), "p_name", F.lit(". More.")), F.lit("function"), "p_name", "p_type", F.lit("fetcher"), call, F.array(F.lit("main_loop")))
    return S.read(spark, sf, "part").select("p_partkey", note.alias("note"))


CATALOG = [("en", "the one", ["the ", "and"], ["tion"]), ("en", "lines", ["\n"], []), ("de", "umlaut", ["ü"], ["xx"]), ("fr", "accent", ["é", "la"], [])]


@query("SELECT doc_id AS chunk_id, pattern FROM documents, (VALUES ('en', 'the one'), ('en', 'lines'), ('de', 'umlaut'), ('fr', 'accent')) c(language, pattern) WHERE lang = language AND CASE pattern WHEN 'the one' THEN contains(text, 'the ') AND contains(text, 'and') AND NOT contains(text, 'tion') WHEN 'lines' THEN contains(text, chr(10)) WHEN 'umlaut' THEN contains(text, 'ü') AND NOT contains(text, 'xx') ELSE contains(text, 'é') AND contains(text, 'la') END")
def mined_patterns(spark, sf):
    return chunking.mine_patterns(S.chunks(spark, sf).withColumn("language", F.col("lang")), CATALOG)


# ---------------------------------------------------------------- numbers


@query("""WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%-m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%dT') ELSE '2024-02-30' END AS d FROM orders)
    SELECT o_orderkey, CASE WHEN regexp_matches(d, '^\\d{4}-\\d{2}-\\d{2}$') THEN epoch(try_strptime(d, '%Y-%m-%d'))::BIGINT END AS seconds FROM d""")
def date_seconds(spark, sf):
    f = lambda p: F.date_format("o_orderdate", p)
    k = F.col("o_orderkey") % 4
    return S.read(spark, sf, "orders").select("o_orderkey", N.date_seconds(F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, f("yyyy-M-dd")).when(k == 2, f("yyyy-MM-dd'T'")).otherwise("2024-02-30")).alias("seconds"))


@query("""WITH s AS (SELECT event_id, event_id * event_id * 7 AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' WHEN s < 604800 THEN (s // 86400) || 'd ago'
    WHEN s < 2592000 THEN (s // 604800) || 'w ago' WHEN s < 31536000 THEN (s // 2592000) || 'mo ago' ELSE (s // 31536000) || 'y ago' END AS age FROM s""")
def ages(spark, sf):
    return S.read(spark, sf, "events").select("event_id", N.age(F.col("event_id") * F.col("event_id") * 7).alias("age"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_reverse(embedding::DOUBLE[]) AS r FROM embeddings), s AS (SELECT *, greatest(list_max(list_transform(v, lambda x: abs(x))) / 127.0, 1e-8) AS s FROM e)
    SELECT vec_id, round(list_distance(v, r), 6) AS l2, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS unit, round(0.5 * v[2] * (1 + tanh(0.7978845608028654 * (v[2] + 0.044715 * v[2] ^ 3))), 6) AS gelu,
    round(least(greatest(round(v[3] / s), -127), 127) * s, 6) AS restored, round(exp(v[4]) / (exp(v[4]) + exp(v[6])), 6) AS yes, round(v[-1], 6) AS logit FROM s""")
def vector_functions(spark, sf):
    x = S.vectors(spark, sf).withColumn("s", N.int8_scale("vector"))
    r = lambda c: F.round(c, 6)
    return x.select(
        F.col("chunk_id").alias("vec_id"), r(N.l2("vector", F.reverse("vector"))).alias("l2"), r(N.normalized("vector")[0]).alias("unit"), r(N.gelu(F.col("vector")[1].cast("double"))).alias("gelu"),
        r(N.dequantized(N.int8("vector", "s"), "s")[2]).alias("restored"), r(N.yes_no_score(N.doubles("vector"), 3, 5)).alias("yes"), r(N.classifier_score(N.doubles("vector"))).alias("logit"),
    )


@query("""WITH r AS (SELECT user_id AS query_id, value / 400 AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events), g AS (SELECT query_id, max(score) FILTER (rank = 1) AS a, coalesce(max(score) FILTER (rank = 2), 0) AS b, avg(score) FILTER (rank <= 3) AS m FROM r GROUP BY 1)
    SELECT query_id, CASE WHEN a > 0.5 AND a - b > 0.15 THEN 'high' WHEN a > 0.25 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN m >= 0.5 THEN 'high' WHEN m >= 0.25 THEN 'medium' ELSE 'low' END AS zone FROM g""")
def response_confidence(spark, sf):
    x = C.top_k(S.read(spark, sf, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("chunk_id"), (F.col("value") / 400).alias("score")), 3)
    return fusion.response_confidence(x).join(x.groupBy("query_id").agg(N.confidence_zone(F.avg("score")).alias("zone")), "query_id")


@query("""WITH t AS (SELECT o_orderkey AS query_id, ['identifier', 'keyword', 'semantic', 'mixed'][(o_orderkey % 4 + 1)::INT] AS t, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 10) / 10 END AS d, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 9) / 9 END AS s, (o_orderkey % 11) / 10 AS e FROM orders),
    r AS (SELECT *, CASE WHEN s > 0 AND d > 0 THEN s / d END AS r FROM t) SELECT query_id, round((CASE t WHEN 'identifier' THEN 0.2 WHEN 'keyword' THEN 0.3 WHEN 'semantic' THEN 0.4 ELSE 0.5 END * CASE WHEN r > 2.5 THEN 0.8 WHEN r < 0.4 THEN 1.3 ELSE 1 END)::DOUBLE, 6) AS w_dense,
    round((CASE t WHEN 'semantic' THEN 0.5 WHEN 'mixed' THEN 0.4 ELSE 0.6 END * CASE WHEN r > 2.5 THEN 1.3 WHEN r < 0.4 THEN 0.8 ELSE 1 END)::DOUBLE, 6) AS w_sparse, round((CASE t WHEN 'identifier' THEN 5.0 WHEN 'keyword' THEN 2.0 ELSE 0.8 END * CASE WHEN e > 0.8 THEN 1.5 ELSE 1 END)::DOUBLE, 6) AS w_exact FROM r""")
def adapted_weights(spark, sf):
    k = F.col("o_orderkey")
    t = S.read(spark, sf, "orders").select(k.alias("query_id"), pick(("identifier", "keyword", "semantic", "mixed"), "o_orderkey").alias("query_type"), F.when(k % 5 > 0, k % 10 / 10).alias("dense"), F.when(k % 7 > 0, k % 9 / 9).alias("sparse"), (k % 11 / 10).alias("exact"))
    return rounded(fusion.adapted_weights(t), 6, "w_dense", "w_sparse", "w_exact")


# ---------------------------------------------------------------- lookups, joins, counts


@query("SELECT doc_id AS chunk_id, length(text)::INT AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def chunk_lookup(spark, sf):
    return relational.lookup(S.chunks(spark, sf), S.read(spark, sf, "labels").select(F.col("doc_id").alias("chunk_id"))).select("chunk_id", F.length("content").alias("n"))


@query(f"WITH {COMMITS} SELECT hash FROM co WHERE hash NOT IN (SELECT event_id FROM events WHERE event_type = 'click')")
def commits_to_insert(spark, sf):
    c = S.commits(spark, sf)
    return maintain.insert_missing(c.where("message like 'click%'"), c.unionByName(c), "hash").select("hash")


@query(f"WITH {COMMITS} SELECT min(ts) AS oldest, count(*) AS commits, count(DISTINCT path) AS files FROM co")
def history_span(spark, sf):
    return S.commits(spark, sf).agg(F.min("ts").alias("oldest"), F.count("*").alias("commits"), F.count_distinct("path").alias("files"))


@query(f"WITH {COMMITS} SELECT hash, ts FROM co WHERE contains(lower(message), 'signup') OR contains(lower(message), '87') ORDER BY ts DESC, hash DESC LIMIT 20")
def commit_messages(spark, sf):
    return relational.search_messages(S.commits(spark, sf), "Signup 87").select("hash", "ts")


@query(f"WITH {COMMITS}, e AS (SELECT *, split_part(message, ' ', 1) AS repo FROM co), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash DESC) AS r FROM e WHERE ts > 1704300000) SELECT hash, ts, repo FROM r WHERE r <= 20 ORDER BY ts DESC, repo, hash DESC LIMIT 20")
def federated_history(spark, sf):
    c = S.commits(spark, sf)
    repos = {k: (c.where(F.startswith("message", F.lit(k))), None) for k in ("click", "error", "purchase", "signup", "view")}
    return P.federated_history(repos, since=1704300000).select("hash", "ts", "repo")


@query("WITH n AS (SELECT conv_id * 100 + turn AS note_id, conv_id AS ts, (contains(lower(text), 'the'))::INT + (contains(lower(text), 'oneshot'))::INT + (contains(lower(text), 'ion.'))::INT AS hits FROM conversations) SELECT note_id, hits FROM n WHERE hits > 0 ORDER BY hits DESC, ts DESC, note_id DESC LIMIT 20")
def notes_containing(spark, sf):
    return relational.recall_contains(S.notes(spark, sf), "The oneshot ion.").select("note_id", "hits")


@query("""WITH n AS (SELECT conv_id * 100 + turn AS note_id, role AS scope, text AS content FROM conversations), w AS (SELECT -note_id AS note_id, scope, trim(content, ' ') AS content FROM n WHERE scope = 'user' UNION ALL SELECT -1000000, 'user', ''), k AS (SELECT * FROM w WHERE content <> '')
    SELECT note_id, scope FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.scope = n.scope AND k.content = n.content) UNION ALL SELECT note_id, scope FROM k""")
def notes_saved(spark, sf):
    n = S.notes(spark, sf)
    new = n.where("scope = 'user'").withColumns({"note_id": -F.col("note_id"), "content": F.concat(F.lit(" "), "content")})
    blank = n.limit(1).select(F.lit(-1000000).cast("long").alias("note_id"), F.lit(0).cast("long").alias("created_ts"), F.lit("user").alias("scope"), F.lit("  ").alias("content"))
    return relational.save_note(n, new.unionByName(blank)).select("note_id", "scope")


@query("SELECT r_name AS project, n_name AS branch FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 2 = 0")
def federation_targets(spark, sf):
    n = S.read(spark, sf, "nation").where("n_nationkey % 2 = 0").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("branches"))
    return relational.targets(S.read(spark, sf, "region").join(n, "r_regionkey", "left").select(F.col("r_name").alias("project"), "branches"))


@query("""WITH o AS (SELECT c_mktsegment AS path, max(c_custkey) AS updated FROM customer GROUP BY 1), n AS (SELECT p_type AS path, max(p_partkey) + 1000000 AS updated FROM part GROUP BY 1 UNION ALL SELECT 'FURNITURE', 5)
    SELECT path, coalesce(n.updated, o.updated) AS updated, CASE WHEN n.path IS NULL THEN 'a' WHEN o.path IS NULL THEN 'b' ELSE 'a,b' END AS branches FROM o FULL JOIN n USING (path)""")
def registry_upsert(spark, sf):
    row = lambda df, path, updated, b: df.groupBy(F.col(path).alias("path")).agg(updated.alias("updated")).select(F.col("path").alias("project"), "path", F.array(F.lit(b)).alias("branches"), "updated")
    old = row(S.read(spark, sf, "customer"), "c_mktsegment", F.max("c_custkey"), "a")
    new = row(S.read(spark, sf, "part"), "p_type", F.max("p_partkey") + 1000000, "b")
    more = old.where("path = 'FURNITURE'").withColumns({"updated": F.lit(5).cast("long"), "branches": F.array(F.lit("b"))})
    return registry.upsert(old, new.unionByName(more)).select("path", "updated", F.array_join("branches", ",").alias("branches"))


@query("SELECT p_partkey AS chunk_id, p_name AS name FROM part WHERE p_brand = 'Brand#13'")
def symbol_definitions(spark, sf):
    p = S.read(spark, sf, "part")
    return relational.symbol_exact(p.select(F.col("p_brand").alias("symbol"), F.col("p_partkey").alias("chunk_id")), p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_name").alias("name")), "Brand#13").select("chunk_id", "name")


@query("SELECT l_partkey::VARCHAR AS name, min(l_linenumber) AS start_line FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber > 1 AND l_linenumber <= 4 GROUP BY 1")
def methods_within(spark, sf):
    d = S.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_path"), F.col("l_linenumber").alias("start_line"), F.col("l_linenumber").alias("end_line"), F.col("l_partkey").cast("string").alias("name"))
    return relational.methods_within(d, S.read(spark, sf, "orders").select(F.col("o_orderkey").alias("file_path"), F.lit(1).alias("start_line"), F.lit(4).alias("end_line")))


@query("SELECT DISTINCT c_custkey AS child_chunk FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_3' OR n_regionkey = 1")
def implementations(spark, sf):
    n = S.read(spark, sf, "nation")
    h = S.read(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("child_chunk"), F.col("n_name").alias("parent_name"), F.col("n_nationkey").alias("parent_chunk"))
    return relational.implementations(h, "NATION_3", n.where("n_regionkey = 1").select(F.col("n_nationkey").alias("chunk_id")))


@query("SELECT c_custkey AS chunk_id FROM customer WHERE c_mktsegment = 'FURNITURE' UNION SELECT p_partkey FROM part WHERE p_type = 'PROMO'")
def symbol_references(spark, sf):
    calls = S.read(spark, sf, "customer").select(F.when(F.col("c_mktsegment") == "FURNITURE", "x").otherwise("y").alias("name"), F.col("c_custkey").alias("chunk_id"))
    refs = S.read(spark, sf, "part").select(F.when(F.col("p_type") == "PROMO", "x").otherwise("y").alias("name"), F.col("p_partkey").alias("chunk_id"))
    return relational.references(calls, refs, "x")


@query("SELECT p_type AS file_path, count(*) AS symbols FROM part GROUP BY 1")
def symbols_per_file(spark, sf):
    return relational.per_file(S.read(spark, sf, "part").select(F.col("p_type").alias("file_path")), "symbols")


SPANS = "SELECT l_orderkey AS query_id, l_linenumber::BIGINT AS chunk_id, l_linenumber AS rank, l_returnflag AS file_path, l_quantity::INT AS start_line, l_quantity::INT + l_linenumber * 3 AS end_line, l_extendedprice AS score, l_linestatus || l_suppkey AS name FROM lineitem"


def spans(spark, sf) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    return S.read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").cast("long").alias("chunk_id"), F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("file_path"), q.alias("start_line"), (q + F.col("l_linenumber") * 3).alias("end_line"), F.col("l_extendedprice").alias("score"), F.concat("l_linestatus", "l_suppkey").alias("name"))


@query(f"WITH s AS ({SPANS}) SELECT a.query_id, a.chunk_id, b.chunk_id AS covers FROM s a JOIN s b ON a.query_id = b.query_id AND a.file_path = b.file_path AND b.rank < a.rank AND least(a.end_line, b.end_line) - greatest(a.start_line, b.start_line) + 1 > 0.5 * (a.end_line - a.start_line + 1)")
def overlapping_results(spark, sf):
    return relational.overlapping(spans(spark, sf))


@query(f"""WITH s AS (SELECT query_id, chunk_id, score, name, file_path, start_line % 3 AS start_line FROM ({SPANS})), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_path, start_line ORDER BY score DESC, chunk_id) AS r FROM s)
    SELECT a.query_id, a.chunk_id, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(b.name) FILTER (b.name IS NOT NULL))), 1, 4), ','), '') AS also FROM r a LEFT JOIN r b ON a.query_id = b.query_id AND a.file_path = b.file_path AND a.start_line = b.start_line AND b.r > 1 WHERE a.r = 1 GROUP BY a.query_id, a.chunk_id, a.file_path, a.start_line""")
def range_dedup(spark, sf):
    x = spans(spark, sf).withColumns({"start_line": F.col("start_line") % 3, "end_line": F.lit(9)})
    return cut.dedup_range(x).select("query_id", "chunk_id", F.array_join("also", ",").alias("also"))


@query(f"WITH s AS (SELECT query_id, file_path AS item, min(rank) AS f FROM ({SPANS}) GROUP BY 1, 2) SELECT query_id, item, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, item) AS INTEGER) AS rank FROM s")
def ranked_files(spark, sf):
    return evaluate.dedup_ranked(spans(spark, sf).select("query_id", F.col("file_path").alias("item"), "rank"))


@query("""WITH u AS (SELECT o_custkey AS query_id, o_orderkey AS chunk_id, o_totalprice AS score, 0 AS o FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, o_totalprice / 2, 1 FROM orders), m AS (SELECT query_id, chunk_id, arg_min(score, o) AS score FROM u GROUP BY 1, 2)
    SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM m) WHERE rank <= 10""")
def merged_drafts(spark, sf):
    o = S.read(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("chunk_id"), F.col("o_totalprice").alias("score"), "o_orderstatus")
    return P.merge_first(o.where("o_orderstatus = 'F'"), o.withColumn("score", F.col("score") / 2), 10)


# ---------------------------------------------------------------- channels and rankings


@query(f"""WITH {BM25}, e AS (SELECT bm.* FROM bm JOIN documents ON doc_id = chunk_id WHERE lang = 'en') SELECT query_id, chunk_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM e) WHERE r <= 10""")
def bm25_among(spark, sf):
    """Only English texts may be found; the statistics are those of the whole index."""
    own = S.chunks(spark, sf).where("lang = 'en'").select("chunk_id")
    return out(C.top_k(rounded(S.text_index(spark, sf).bm25(S.queries(spark, sf), {"content": 1.0}, among=own)), 10))


@query("""WITH q AS (SELECT vec_id // 100 AS query_id, vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0), m AS (SELECT query_id, pos, vec_id // 8 AS chunk_id, max(list_dot_product(v, e.embedding::DOUBLE[])) AS best FROM q, embeddings e WHERE e.label < 5 GROUP BY 1, 2, 3)
    SELECT query_id, chunk_id, round(sum(best), 6) AS score FROM m GROUP BY 1, 2""")
def maxsim_among(spark, sf):
    """All scores over the tokens of a subset; the queries go out in several blocks."""
    v = S.vectors(spark, sf)
    d = v.where("label < 5").select(F.floor(F.col("chunk_id") / 8).alias("chunk_id"), "vector")
    q = v.where("chunk_id % 20 = 0").select(F.floor(F.col("chunk_id") / 100).alias("query_id"), F.col("chunk_id").alias("pos"), "vector")
    return out(C.maxsim(d, q, most_tokens=40))


@query(f"""WITH {CHANNELS}, f AS (SELECT query_id, chunk_id, round(sum(CASE channel WHEN 'dense' THEN 0.3 ELSE 0.7 END / (60.0 + rank)), 9) AS score FROM ra WHERE channel <> 'exact' GROUP BY 1, 2), x AS ({TOP20.format('f')}) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM x""")
def rrf_two_lists(spark, sf):
    a = all_channels(spark, sf).where("channel <> 'exact'")
    return out(C.top_k(rounded(fusion.rrf(a, weights={"dense": 0.3, "sparse": 0.7})), 20), "rank")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT *, greatest(list_max(list_transform(v, lambda x: abs(x))) / 127.0, 1e-8) AS s FROM e), q AS (SELECT *, list_transform(v, lambda x: least(greatest(round(x / s), -127), 127)) AS q FROM s),
    c AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.q, b.q) * (b.s / sqrt(list_dot_product(b.v, b.v))), 9) AS rough, round(list_cosine_similarity(a.v, b.v), 9) AS score FROM q a, q b WHERE a.vec_id % 20 = 0),
    w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rough DESC, chunk_id) AS r FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS k FROM w WHERE r <= 20) SELECT query_id, chunk_id, round(score, 6) AS score FROM f WHERE k <= 5""")
def int8_two_stage(spark, sf):
    v = S.vectors(spark, sf)
    s = store.VectorStore(spark, new_folder(spark, "vectors"))
    s.append(v)
    return out(s.two_stage(v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "vector"), 5))


@query("""WITH c AS (SELECT vec_id AS cached_id, embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id DESC LIMIT 1000), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT query_id, cached_id, round(list_cosine_similarity(q.v, c.v), 9) AS similarity FROM q, c WHERE query_id <> cached_id)
    SELECT query_id, -arg_max(-cached_id, (similarity, -cached_id)) AS cached_id, round(max(similarity), 6) AS similarity FROM s WHERE similarity >= 0.2 GROUP BY 1""")
def query_cache(spark, sf):
    """Vectors as queries, and the latest thousand of them as the cache, itself left out."""
    v = S.vectors(spark, sf)
    c = v.select(F.col("chunk_id").alias("cached_id"), "vector", F.lit("s").alias("stamp"))
    q = v.select(F.col("chunk_id").alias("query_id"), "vector")
    return rounded(store.semantic_cache(c, q, "s", 0.2, others=True), 6, "similarity")


@query(f"""WITH {SCORED}, n AS (SELECT *, CASE chunk_id % 3 WHEN 0 THEN 'getThe' WHEN 1 THEN 'get' || split_part(query, ' ', 2) ELSE NULL END AS name, max(score) OVER (PARTITION BY query_id) AS mx FROM sc), k AS (SELECT item_id AS query_id, list_filter({toks('text')}, lambda t: NOT contains(t, '_') AND t NOT IN ({listed(T.PATH_STOPWORDS)})) AS k FROM benchmark)
    SELECT query_id, chunk_id, round(score + CASE WHEN coalesce(list_has_any(list_append({sub(camel('name'))}, lower(name)), k), false) THEN 0.2 ELSE 0 END * mx, 6) AS score FROM n JOIN k USING (query_id)""")
def definition_boost(spark, sf):
    name = F.when(F.col("chunk_id") % 3 == 0, "getThe").when(F.col("chunk_id") % 3 == 1, F.concat(F.lit("get"), F.split_part("query", F.lit(" "), F.lit(2))))
    return out(rescore.definition_boost(scored(spark, sf).withColumn("name", name)))


FOLDERS = ("src/tests/", "lib/legacy/x", "examples/", "a/b/")


@query(f"""WITH {SCORED}, pp AS (SELECT *, '/' || {pick_sql(FOLDERS, 'chunk_id')} || chunk_id || '.py/' AS p FROM sc) SELECT query_id, chunk_id, round(score * CASE WHEN regexp_matches(lower(query), '(^|[^a-z0-9])({'|'.join(T.PENALTY_OFF)})([^a-z0-9]|$)') THEN 1.0 ELSE
    CASE WHEN regexp_matches(p, '/(tests|test|__tests__|spec)/') THEN 0.3 ELSE 1 END * CASE WHEN regexp_matches(p, '/(compat|legacy|deprecated|polyfill)/') THEN 0.3 ELSE 1 END * CASE WHEN regexp_matches(p, '/(examples?|demos?|samples?)/') THEN 0.3 ELSE 1 END END, 6) AS score FROM pp""")
def penalty_stage(spark, sf):
    return out(rescore.path_penalty(scored(spark, sf).withColumn("file_path", F.concat(pick(FOLDERS, "chunk_id"), "chunk_id", F.lit(".py")))))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r, max(score) OVER (PARTITION BY query_id) AS mx, split_part(file_path, '/', 1) = 'src' || (query_id % 10) OR split_part(file_path, '/', 1) = 'src1' AS near FROM sc),
    m AS (SELECT *, avg(score) FILTER (r <= 5) OVER (PARTITION BY query_id) AS mean FROM r) SELECT query_id, chunk_id, round(CASE WHEN near AND r > 5 THEN greatest(score, least(score + 0.10 * mean, mx)) ELSE score END, 6) AS score FROM m""")
def import_proximity(spark, sf):
    x = scored(spark, sf).withColumn("file_path", T.top_dir("file_path"))
    near = S.queries(spark, sf).select("query_id", F.explode(F.array(F.concat(F.lit("src"), F.col("query_id") % 10), F.lit("src1"))).alias("file_path"))
    return out(rescore.import_proximity(x, near))


@query(f"""WITH {SCORED}, d AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN lang ELSE file_path END AS dir, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM sc JOIN (SELECT doc_id AS chunk_id, lang FROM documents) USING (chunk_id)),
    tp AS (SELECT query_id, count(DISTINCT dir) AS dirs, avg(score) AS mean FROM d WHERE r <= 10 GROUP BY 1), bd AS (SELECT query_id, dir, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, dir) AS k FROM d WHERE r <= 10 GROUP BY 1, 2)
    SELECT query_id, chunk_id, round(score + CASE WHEN dirs < 10 / 3 AND r > 10 AND EXISTS (SELECT 1 FROM bd WHERE bd.query_id = d.query_id AND bd.dir = d.dir AND k <= 3) THEN 0.08 * mean ELSE 0 END, 6) AS score FROM d JOIN tp USING (query_id)""")
def directory_proximity(spark, sf):
    x = scored(spark, sf).join(S.chunks(spark, sf).select("chunk_id", "lang"), "chunk_id")
    x = x.withColumn("file_path", F.concat(F.when(F.col("query_id") % 2 == 0, F.col("lang")).otherwise(F.col("file_path")), F.lit("/x")))
    return out(rescore.directory_proximity(x))


@query(f"""WITH {SCORED}, c AS (SELECT sc.*, coalesce(length(text)::DOUBLE, 0) AS c FROM sc LEFT JOIN documents ON doc_id = chunk_id AND lang = 'en'), m AS (SELECT *, min(c) OVER w AS lo, max(c) OVER w AS hi, max(score) OVER w AS mx FROM c WINDOW w AS (PARTITION BY query_id))
    SELECT query_id, chunk_id, round(score + CASE WHEN hi > lo THEN 0.2 * mx * (c - lo) / (hi - lo) ELSE 0 END, 6) AS score FROM m""")
def centrality_prior(spark, sf):
    c = S.chunks(spark, sf).where("lang = 'en'").select("chunk_id", F.length("content").cast("double").alias("centrality"))
    return out(rescore.centrality_prior(scored(spark, sf), c, 0.2))


@query(f"""WITH {SCORED}, w AS (SELECT *, list_distinct(list_filter(string_split(lower(query), ' '), lambda w: length(w) > 1)) AS ws FROM (SELECT DISTINCT query_id, chunk_id, score, regexp_replace(query, '\\s+', ' ', 'g') AS query, left(content, 300) AS doc FROM sc))
    SELECT query_id, chunk_id, round(score + least(0.15 * len(list_filter(ws, lambda w: contains(lower(doc), w))), 0.6), 6) AS score FROM w""")
def docstring_boost(spark, sf):
    x = scored(spark, sf).withColumn("doc", F.left("content", F.lit(300)))
    return out(x.withColumn("score", F.col("score") + rescore.docstring_boost("query", "doc")))


#: A recursion that picks one chunk after another.
ORACLE_SQL["mmr"] = """WITH RECURSIVE q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)), s AS (SELECT query_id, e.vec_id AS chunk_id, round(list_cosine_similarity(v, e.embedding::DOUBLE[]), 9) AS score FROM q, embeddings e),
    h AS MATERIALIZED (SELECT query_id, chunk_id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM s) WHERE r <= 50), vs AS MATERIALIZED (SELECT h.*, embedding::DOUBLE[] AS v, max(score) OVER (PARTITION BY query_id) AS mx FROM h JOIN embeddings ON vec_id = chunk_id),
    p AS MATERIALIZED (SELECT a.query_id, a.r AS i, b.r AS j, list_cosine_similarity(a.v, b.v) AS sim FROM vs a JOIN vs b USING (query_id)),
    g AS (SELECT query_id, 1 AS k, [1] AS picked FROM vs WHERE r = 1 UNION ALL SELECT g.query_id, g.k + 1, list_append(picked, (SELECT arg_min(c.r, (-(0.7 * c.score / CASE WHEN c.mx > 0 THEN c.mx ELSE 1 END - 0.3 * (SELECT max(sim) FROM p WHERE p.query_id = g.query_id AND p.i = c.r AND list_contains(g.picked, p.j))), c.r)) FROM vs c WHERE c.query_id = g.query_id AND NOT list_contains(g.picked, c.r))) FROM g WHERE g.k < (SELECT count(*) FROM vs WHERE vs.query_id = g.query_id)),
    l AS (SELECT query_id, arg_max(picked, k) AS picked FROM g GROUP BY 1), u AS (SELECT query_id, unnest(picked) AS r, generate_subscripts(picked, 1)::INT AS rank FROM l) SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM u JOIN vs USING (query_id, r)"""


def _elbow(name: str, source: str, low: str, high: str, least: float) -> str:
    window = "(PARTITION BY query_id ORDER BY score DESC, chunk_id)"
    inside = "i >= greatest({0}low, 1) AND i < least({0}n, {0}high)"
    return f"""{name}_i AS (SELECT *, row_number() OVER {window} - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n, max(score) OVER (PARTITION BY query_id) AS top, lag(score) OVER {window} AS prev, {low} AS low, {high} AS high FROM {source}),
    {name}_d AS (SELECT query_id, any_value(n) AS n, any_value(top) AS top, any_value(low) AS low, any_value(high) AS high, max(CASE WHEN {inside.format('')} AND prev > score THEN (prev - score) / top END) AS fall FROM {name}_i GROUP BY 1),
    {name}_e AS (SELECT d.query_id, d.n, d.top, d.low, d.high, fall, min(CASE WHEN {inside.format('d.')} AND (prev - score) / d.top = fall THEN i END) AS place FROM {name}_d d JOIN {name}_i USING (query_id) GROUP BY ALL),
    {name} AS (SELECT query_id, least(15, CASE WHEN n <= low THEN n WHEN top <= 0 THEN least(low, n) ELSE least(greatest(low, least(high, CASE WHEN coalesce(fall, 0) < {least} THEN least(n, high) ELSE place END)), n) END) AS keep FROM {name}_e)"""


RANKED = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank"
ORACLE_SQL["adaptive_cut"] = f"""WITH {SCORED}, {TYPE_SQL}, a1 AS (SELECT sc.query_id, chunk_id, score, split_part(file_path, '/', 1) AS file, query_type, max(score) OVER (PARTITION BY query_id) AS top FROM sc JOIN ty USING (query_id)),
    a2 AS (SELECT * EXCLUDE top, max(score) OVER (PARTITION BY query_id, file) AS best FROM a1 WHERE top <= 0 OR score >= top * CASE query_type WHEN 'identifier' THEN 0.08 WHEN 'keyword' THEN 0.15 ELSE 0.10 END), a3 AS (SELECT * FROM a2 WHERE best - score < 0.1),
    b1 AS (SELECT * FROM a3 WHERE query_type <> 'identifier'), {_elbow('b2', 'b1', "CASE query_type WHEN 'mixed' THEN 5 ELSE 3 END", '15', 0.02)}, b3 AS (SELECT *, {RANKED} FROM b1),
    c1 AS (SELECT * FROM a3 WHERE query_type = 'identifier'), c2 AS (SELECT query_id, file AS chunk_id, max(score) AS score FROM c1 GROUP BY 1, 2), {_elbow('c3', 'c2', '3', '15', 0.005)}, c4 AS (SELECT query_id, chunk_id AS file, {RANKED}, count(*) OVER (PARTITION BY query_id) AS files FROM c2),
    c5 AS (SELECT *, {RANKED} FROM c1), c6 AS (SELECT c5.query_id, c5.chunk_id, c5.score FROM c5 JOIN c4 USING (query_id, file) JOIN c3 USING (query_id) WHERE CASE WHEN keep * 3 <= files * 2 THEN c4.rank <= keep ELSE c5.rank <= 15 END)
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM b3 JOIN b2 USING (query_id) WHERE rank <= keep UNION ALL SELECT query_id, chunk_id, round(score, 6), {RANKED} FROM c6"""


# ---------------------------------------------------------------- graph


@query(f"""WITH {EDGES}, s AS (SELECT 's' || chunk_id AS symbol, chunk_id FROM nodes), d1 AS (SELECT DISTINCT symbol, dst AS chunk_id FROM s JOIN ed ON src = chunk_id WHERE dst <> s.chunk_id), d2 AS (SELECT DISTINCT symbol, dst AS chunk_id FROM d1 JOIN ed ON src = chunk_id)
    SELECT symbol, chunk_id, 1 AS depth FROM d1 UNION ALL SELECT symbol, chunk_id, 2 FROM d2 WHERE NOT EXISTS (SELECT 1 FROM d1 WHERE d1.symbol = d2.symbol AND d1.chunk_id = d2.chunk_id) AND symbol <> 's' || chunk_id""")
def callees_two_deep(spark, sf):
    s = S.nodes(spark, sf).select(F.concat(F.lit("s"), "chunk_id").alias("symbol"), "chunk_id")
    return graph.callees(s, S.edges(spark, sf), 2)


@query(f"WITH {EDGES} SELECT DISTINCT 's' || n.chunk_id AS symbol, src AS chunk_id, 1 AS depth FROM nodes n JOIN ed ON dst = n.chunk_id WHERE src <> dst")
def callers_of_all(spark, sf):
    return graph.callers(S.nodes(spark, sf).select(F.concat(F.lit("s"), "chunk_id").alias("symbol"), "chunk_id"), S.edges(spark, sf))


@query(f"WITH {EDGES} SELECT 's' || n.chunk_id AS symbol, n.chunk_id, (SELECT count(DISTINCT src) FROM ed WHERE dst = n.chunk_id AND src <> dst) AS callers, (SELECT count(DISTINCT dst) FROM ed WHERE src = n.chunk_id) AS callees FROM nodes n")
def symbol_cards(spark, sf):
    return graph.symbol_card(S.nodes(spark, sf).select(F.concat(F.lit("s"), "chunk_id").alias("symbol"), "chunk_id"), S.edges(spark, sf))


@query(f"WITH {EDGES}, d AS (SELECT dst AS chunk_id, count(*) AS centrality FROM ed GROUP BY 1) SELECT chunk_id, centrality FROM d JOIN nodes USING (chunk_id) ORDER BY centrality DESC, chunk_id LIMIT 10")
def god_nodes(spark, sf):
    c = S.edges(spark, sf).groupBy(F.col("dst").alias("chunk_id")).agg(F.count("*").alias("centrality"))
    return graph.god_nodes(c, S.nodes(spark, sf))


@query(f"""WITH {IMPORTS}, f AS (SELECT importer AS p FROM im UNION SELECT imported FROM im), c AS (SELECT row_number() OVER (ORDER BY p) AS chunk_id, p FROM f), s AS (SELECT n_regionkey AS query_id, chunk_id, n_nationkey + 1.0 AS score, p FROM nation JOIN c ON p = 'nations/' || n_name || '/mod.py'),
    nb AS (SELECT DISTINCT query_id, importer AS p FROM s JOIN im ON imported = p UNION SELECT query_id, imported FROM s JOIN im ON importer = p), n AS (SELECT nb.query_id, c.chunk_id FROM nb JOIN c USING (p) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = nb.query_id AND s.chunk_id = c.chunk_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS r FROM n) SELECT query_id, chunk_id, round((0.3 * (SELECT max(score) FROM s WHERE s.query_id = r.query_id))::DOUBLE, 6) AS score FROM r WHERE r <= 25""")
def module_cohesion(spark, sf):
    im = S.imports(spark, sf)
    files = im.select(F.col("importer").alias("file_path")).union(im.select("imported")).distinct()
    # a row a file, numbered in order of path
    from pyspark.sql import Window

    c = files.withColumn("chunk_id", F.row_number().over(Window.orderBy("file_path")).cast("long"))
    s = S.read(spark, sf, "nation").select(F.col("n_regionkey").alias("query_id"), (F.col("n_nationkey") + 1.0).alias("score"), F.concat(F.lit("nations/"), "n_name", F.lit("/mod.py")).alias("file_path")).join(c, "file_path")
    return out(graph.module_cohesion(s, c, im, 0.3, 25))


@query("""SELECT 'src/s' || s_suppkey || '.py' AS importer, 'lib/n' || s_nationkey || '.py' AS imported FROM supplier UNION ALL SELECT 'src/c' || c_custkey || '.ts', CASE WHEN c_custkey % 2 = 0 THEN 'lib/n' || c_nationkey || '/index.ts' ELSE 'lib/t' || c_nationkey || '.ts' END FROM customer
    UNION ALL SELECT 'lib/n' || n_nationkey || '.py', 'lib/shared/__init__.py' FROM nation UNION ALL SELECT 'rs/src/m' || n_nationkey || '.rs', 'rs/src/shared/mod.rs' FROM nation""")
def resolved_imports(spark, sf):
    """Sources made of the rows: Python, TypeScript and Rust files that import one another."""
    s, c, n = (S.read(spark, sf, t) for t in ("supplier", "customer", "nation"))
    row = lambda df, path, content, language: df.select(F.concat(*path).alias("path"), F.concat(*content).alias("content"), F.lit(language).alias("language"))
    lit = F.lit
    ts = F.when(F.col("c_custkey") % 2 == 0, F.concat(lit("../lib/n"), "c_nationkey")).otherwise(F.concat(lit("../lib/t"), "c_nationkey", lit(".js")))
    files = [
        row(s, (lit("src/s"), "s_suppkey", lit(".py")), (lit("import os\nfrom lib.n"), "s_nationkey", lit(" import x, y\n")), "python"),
        row(c, (lit("src/c"), "c_custkey", lit(".ts")), (lit("import fs from 'fs';\nimport { a } from '"), ts, lit("';\n")), "typescript"),
        row(n, (lit("lib/n"), "n_nationkey", lit(".py")), (lit("from .shared import z\n"),), "python"), row(n, (lit("lib/n"), "n_nationkey", lit("/index.ts")), (lit("export {};"),), "typescript"),
        row(n, (lit("lib/t"), "n_nationkey", lit(".ts")), (lit(""),), "typescript"), row(n, (lit("rs/src/m"), "n_nationkey", lit(".rs")), (lit("use std::io;\nuse crate::shared::{A, B};\n"),), "rust"),
        row(n.limit(1), (lit("lib/shared/__init__.py"),), (lit(""),), "python"), row(n.limit(1), (lit("rs/src/shared/mod.rs"),), (lit(""),), "rust"),
    ]
    u = files[0]
    for f in files[1:]:
        u = u.unionByName(f)
    return imports.resolve(u)


# ---------------------------------------------------------------- evaluation and upkeep


@query("""WITH l AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS file_path, doc_id, unnest(string_split(lower(text), chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), w AS (SELECT DISTINCT file_path, doc_id, i, unnest(regexp_extract_all(line, '[a-z_][a-z0-9_]{2,}')) AS word FROM l),
    k AS (SELECT DISTINCT n_nationkey AS query_id, unnest(['the', 'tion' || n_nationkey, 'and', 'oush']) AS word FROM nation WHERE n_nationkey < 3 UNION ALL SELECT n_nationkey, 'erth' FROM nation), h AS (SELECT query_id, file_path, count(*) AS hits FROM (SELECT DISTINCT query_id, file_path, doc_id, i FROM w JOIN k USING (word)) GROUP BY 1, 2)
    SELECT query_id, file_path, hits, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, file_path) AS INTEGER) AS rank FROM h""")
def keyword_files(spark, sf):
    n = S.read(spark, sf, "nation")
    k = n.where("n_nationkey < 3").select(F.col("n_nationkey").alias("query_id"), F.explode(F.array(F.lit("the"), F.concat(F.lit("tion"), "n_nationkey"), F.lit("and"), F.lit("oush"))).alias("word")).unionByName(n.select(F.col("n_nationkey").alias("query_id"), F.lit("erth").alias("word")))
    return evaluate.keyword_ranking(S.chunks(spark, sf), k)


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b FROM labels), n AS (SELECT *, only_a + only_b AS n, least(only_a, only_b) AS k FROM c)
    SELECT only_a, only_b, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))))) END, 9) AS p FROM n""")
def paired_test(spark, sf):
    o = S.read(spark, sf, "labels").select(F.col("doc_id").alias("item"), (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))
    return rounded(metrics.mcnemar(o), 9, "p")


@query("SELECT role AS run, count(*) AS turns, sum(length(text) + turn + conv_id)::BIGINT AS burden, sum(ceil(length(text) / 4))::BIGINT AS tokens FROM conversations GROUP BY 1")
def context_burden(spark, sf):
    t = S.read(spark, sf, "conversations").select(F.col("role").alias("run"), F.length("text").alias("input_tokens"), F.col("turn").alias("cache_creation"), F.col("conv_id").alias("cache_read"), evaluate.estimated_tokens("text").alias("tokens"))
    return evaluate.context_burden(t, "run").join(t.groupBy("run").agg(F.sum("tokens").alias("tokens")), "run")


@query("SELECT role AS run, tool, count(*) AS n FROM (SELECT role, unnest(list_distinct([role, 'turn' || (turn % 3)])) AS tool FROM conversations) GROUP BY 1, 2")
def tool_counts(spark, sf):
    t = S.read(spark, sf, "conversations").select(F.col("role").alias("run"), F.array("role", F.concat(F.lit("turn"), F.col("turn") % 3)).alias("tool_calls"))
    return evaluate.tool_distribution(t, "run")


@query("SELECT event_type AS arm, round(avg(value), 4) AS quality, round(avg(user_id), 4) AS cost, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY 1")
def pareto_arms(spark, sf):
    e = S.read(spark, sf, "events").select(F.col("event_type").alias("arm"), F.col("value").alias("quality"), F.col("user_id").alias("cost"), F.when(F.col("event_type") == "error", "x").alias("error"))
    return evaluate.pareto(e)


@query("""WITH s AS (SELECT user_id AS query_id, event_type AS arm, round(avg(value), 9) AS score FROM events GROUP BY ALL), b AS (SELECT query_id, arg_max(arm, (score, arm)) AS best_arm, max(score) AS best FROM s GROUP BY 1)
    SELECT best_arm, arm, count(*) AS n, round(avg(best - score), 6) AS mean_regret FROM s JOIN b USING (query_id) WHERE arm = 'click' GROUP BY 1, 2""")
def route_confusion(spark, sf):
    s = S.read(spark, sf, "events").groupBy(F.col("user_id").alias("query_id"), F.col("event_type").alias("arm")).agg(F.round(F.avg("value"), 9).alias("score")).withColumn("chosen", F.col("arm") == "click")
    return rounded(metrics.confusion(metrics.regret(s)), 6, "mean_regret")


@query("""SELECT 'chunks' AS check_name, 200::BIGINT AS expected, (SELECT count(DISTINCT doc_id) FROM documents) AS found, (SELECT count(DISTINCT doc_id) FROM documents) = 200 AS ok UNION ALL SELECT 'vectors', 500, (SELECT count(DISTINCT vec_id) FROM embeddings), (SELECT count(DISTINCT vec_id) FROM embeddings) = 500
    UNION ALL SELECT 'postings', 87, (SELECT count(DISTINCT doc_id) FROM labels), (SELECT count(DISTINCT doc_id) FROM labels) = 87 UNION ALL SELECT 'signals', 1, 0, false""")
def index_checks(spark, sf):
    meta = spark.createDataFrame([("chunks", 200), ("vectors", 500), ("postings", 87), ("signals", 1)], "check_name string, expected long")
    ids = lambda t, c: S.read(spark, sf, t).select(F.col(c).alias("chunk_id"))
    return maintain.validate(meta, ids("documents", "doc_id"), ids("labels", "doc_id"), ids("embeddings", "vec_id"))


@query(f"WITH {EDGES}, g AS (SELECT p_partkey * 4 AS c FROM part WHERE p_type = 'PROMO') SELECT kind, count(*) AS n FROM ed WHERE src NOT IN (SELECT c FROM g) GROUP BY 1")
def cascade(spark, sf):
    gone = S.read(spark, sf, "part").where("p_type = 'PROMO'").select((F.col("p_partkey") * 4).alias("chunk_id"))
    return maintain.delete_cascade({"e": S.edges(spark, sf)}, gone, {"e": "src"})["e"].groupBy("kind").agg(F.count("*").alias("n"))


MIXED = "[0.1, 0.2, 1.0, -0.3, 0.05]"


@query(f"""WITH t AS (SELECT label AS chunk_id, vec_id AS pos, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT chunk_id, pos, [lag(v, 2) OVER w, lag(v, 1) OVER w, v, lead(v, 1) OVER w, lead(v, 2) OVER w] AS n FROM t WINDOW w AS (PARTITION BY chunk_id ORDER BY pos)),
    s AS (SELECT chunk_id, pos, list_transform(range(1, 65), lambda i: list_sum(list_transform(range(1, 6), lambda k: {MIXED}[k] * coalesce(n[k][i], 0)))) AS s FROM n) SELECT chunk_id, pos, round(s[1] / sqrt(list_dot_product(s, s)), 6) AS first, round(s[64] / sqrt(list_dot_product(s, s)), 6) AS last FROM s""")
def token_mixing(spark, sf):
    t = S.vectors(spark, sf).select(F.col("label").alias("chunk_id"), F.col("chunk_id").alias("pos"), "vector")
    m = vectors.mix(t, [0.1, 0.2, 1.0, -0.3, 0.05])
    return m.select("chunk_id", "pos", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[63], 6).alias("last"))


@query("""WITH ce AS (SELECT vec_id::INT AS cid, embedding::DOUBLE[] AS c FROM embeddings WHERE vec_id < 16), d AS (SELECT vec_id, cid, round(list_dot_product(embedding::DOUBLE[], c), 12) AS dot FROM embeddings, ce), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dot DESC, cid) AS r FROM d),
    un AS (SELECT DISTINCT e.vec_id, r.cid FROM embeddings e JOIN r ON r.vec_id IN (e.vec_id // 2, e.vec_id // 3) AND r.r <= 4), b AS (SELECT vec_id, cid, row_number() OVER (PARTITION BY vec_id ORDER BY dot DESC, cid) AS k FROM un JOIN d USING (vec_id, cid))
    SELECT round(avg((b.cid = r.cid)::INT), 6) AS agreement, count(*) AS n FROM b JOIN r USING (vec_id) WHERE k = 1 AND r.r = 1""")
def shortlist_agreement(spark, sf):
    v = S.vectors(spark, sf)
    c = v.where("chunk_id < 16").select(F.col("chunk_id").cast("int").alias("cid"), "vector")
    lists = vectors.shortlist(v.select(F.col("chunk_id").alias("token_id"), "vector"), c, 4)
    x = v.select(F.col("chunk_id").alias("vec_id"), "vector", F.array(F.floor(F.col("chunk_id") / 2), F.floor(F.col("chunk_id") / 3)).alias("token_ids"))
    return rounded(vectors.agreement(vectors.shortlist_argmax(x, lists, c), vectors.full_argmax(x, c)), 6, "agreement")


@query("""WITH p AS (SELECT 1 AS o, 'imports' AS section, 'nations/' || n_name || '/mod.py' AS line FROM (SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'FURNITURE')), r AS (SELECT *, row_number() OVER (ORDER BY o, line) AS rank, ceil(length(line) / 4) AS s FROM p), u AS (SELECT *, sum(s) OVER (ORDER BY rank) AS used FROM r)
    SELECT rank::INT AS rank, section, line FROM u WHERE used <= 60 OR rank = 1""")
def folder_scaffold(spark, sf):
    c = S.chunks(spark, sf).withColumn("name", F.lit(None).cast("string"))
    return P.module_scaffold(P.Index(c, imports=S.imports(spark, sf)), "FURNITURE", 60)


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc), l AS (SELECT *, '### ' || file_path || ':1-' || len(string_split(content, chr(10))) || chr(10) || CASE WHEN rank <= 5 THEN left(content, 8000) ELSE string_split(content, chr(10))[1] END || chr(10) AS b FROM r),
    u AS (SELECT *, sum(length(b)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM l) SELECT query_id, md5(string_agg(b, '' ORDER BY rank)) AS text FROM u WHERE used <= 16000 OR rank = 1 GROUP BY 1""")
def code_blocks(spark, sf):
    x = C.top_k(scored(spark, sf).withColumns({"start_line": F.lit(1), "end_line": F.size(F.split("content", "\n"))}), 100)
    return P.formatted_blocks(x).select("query_id", F.md5("text").alias("text"))


@query(f"""WITH {CHANNELS}, fu AS (SELECT query_id, chunk_id, round(sum(1 / (60.0 + rank)), 9) AS score FROM ra GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu), n AS (SELECT r.*, lang AS name FROM r JOIN documents ON doc_id = chunk_id WHERE rank <= 20),
    a AS (SELECT query_id FROM n WHERE rank = 1 AND query_id % 2 = 0), g AS (SELECT query_id, name, min(rank) AS rank FROM n WHERE query_id IN (SELECT query_id FROM a) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, name) AS k FROM g) SELECT query_id, name, rank::INT AS rank FROM k WHERE k <= 3""")
def name_suggestions(spark, sf):
    x = C.top_k(rounded(fusion.rrf(all_channels(spark, sf))), 20).join(S.chunks(spark, sf).select("chunk_id", F.col("lang").alias("name")), "chunk_id")
    return P.suggestions(x.withColumn("label", F.when(F.col("query_id") % 2 == 0, "ambiguous").otherwise("inferred")))


# ---------------------------------------------------------------- chunks, files and tables of the index


@query("SELECT p_partkey, p_size * 400 + 1 <= 8192 AS binary FROM part")
def binary_files(spark, sf):
    """A NUL after so many characters; only the first 8 KiB count."""
    content = F.encode(F.concat(F.repeat(F.lit("x"), (F.col("p_size") * 400).cast("int")), F.lit("\0y")), "UTF-8")
    return S.read(spark, sf, "part").select("p_partkey", FS.binary(content).alias("binary"))


PART_CHUNKS = "SELECT p_partkey AS chunk_id, p_type AS file_path, 'f' || p_size AS name, ['f' || (p_size + 1), 'm.f' || (p_size % 7), 'x.f' || p_size] AS calls FROM part"


def part_chunks(spark, sf) -> DataFrame:
    f = lambda x: F.concat(F.lit("f"), x.cast("string"))
    n = F.col("p_size")
    return S.read(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), F.col("p_type").alias("file_path"), f(n).alias("name"), F.array(f(n + 1), F.concat(F.lit("m."), f(n % 7)), F.concat(F.lit("x."), f(n))).alias("calls"))


@query(f"WITH c AS ({PART_CHUNKS}), e AS (SELECT chunk_id, file_path, string_split(unnest(calls), '.')[-1] AS name FROM c) SELECT DISTINCT e.chunk_id AS src, c.chunk_id AS dst FROM e JOIN c USING (file_path, name) WHERE e.chunk_id <> c.chunk_id")
def calls_in_file(spark, sf):
    return chunking.call_edges(part_chunks(spark, sf))


@query(f"WITH c AS ({PART_CHUNKS}), e AS (SELECT chunk_id, file_path, string_split(unnest(calls), '.')[-1] AS name FROM c), d AS (SELECT DISTINCT e.chunk_id AS src, c.chunk_id AS dst FROM e JOIN c USING (file_path, name) WHERE e.chunk_id <> c.chunk_id) SELECT dst AS chunk_id, array_to_string(list_sort(list_distinct(list(c.name))), ',') AS called_by FROM d JOIN c ON c.chunk_id = src GROUP BY 1")
def callers_in_file(spark, sf):
    return chunking.called_by(part_chunks(spark, sf)).select("chunk_id", F.array_join("called_by", ",").alias("called_by"))


SUMMARY = "'function ' || p_name || '; params a, b; calls ' || p_type || CASE WHEN p_size % 50 > 1 THEN '; complexity ' || (p_size % 50) ELSE '' END || '; Does ' || p_brand"


def known(spark, sf) -> DataFrame:
    two = F.array(F.lit("a"), F.lit("b"))
    return S.read(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), F.lit("function").alias("ast_kind"), F.col("p_name").alias("name"), two.alias("params"), F.array("p_type").alias("calls"), (F.col("p_size") % 50).alias("complexity"), F.concat(F.lit("Does "), "p_brand", F.lit("\nmore")).alias("docstring"), F.concat(F.lit("call getItemById "), "p_name").alias("content"))


@query(f"SELECT p_partkey AS chunk_id, {SUMMARY} AS summary, 'by get id item' || chr(10) || {SUMMARY} || chr(10) || 'call getItemById ' || p_name AS indexed FROM part")
def chunk_summaries(spark, sf):
    x = known(spark, sf)
    return x.select("chunk_id", chunking.summary(x).alias("summary"), chunking.index_text(x).alias("indexed"))


ROLE_PATHS = ("src/services/a.py", "x/models/b.py", "tests/c.py", "README.md", "src/plain.py", "db/migrate/d.rb", "a/utils/e.ts", "main.go")
LINKED = ("sqlalchemy.orm", "fastapi", "pytest", "os")


@query(f"""WITH p AS (SELECT p_partkey, lower({pick_sql(ROLE_PATHS, 'p_partkey')}) AS p, {pick_sql(LINKED, 'p_size')} AS i FROM part), r AS (SELECT *, CASE {' '.join(f"WHEN {some_of('p', names)} THEN {quoted(role)}" for role, names, _ in T.FILE_ROLES)} {' '.join(f"WHEN {some_of('i', names)} THEN {quoted(role)}" for role, names in T.IMPORT_ROLES)} ELSE 'unknown' END AS role FROM p)
    SELECT p_partkey, role, (CASE role {' '.join(f"WHEN {quoted(role)} THEN {weight}" for role, _, weight in T.FILE_ROLES)} ELSE 1 END)::DOUBLE AS weight FROM r""")
def file_roles(spark, sf):
    x = S.read(spark, sf, "part").withColumn("role", T.file_role(pick(ROLE_PATHS, "p_partkey"), F.array(pick(LINKED, "p_size"))))
    return x.select("p_partkey", "role", T.role_weight("role").alias("weight"))


@query("SELECT event_id, (props ->> 'k')::INT AS k, '{\"kind\":\"' || event_type || '\",\"n\":' || user_id || '}' AS meta FROM events")
def json_metadata(spark, sf):
    x = S.read(spark, sf, "events")
    return x.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("n"))).alias("meta"))


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc), l AS (SELECT *, file_path || ':1-9  ' || format('{{:,.4f}}', score) || chr(10) AS b FROM r), u AS (SELECT *, sum(strlen(b)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM l)
    SELECT query_id, string_agg(b, '' ORDER BY rank) AS text FROM u WHERE used <= 1200 OR rank = 1 GROUP BY 1""")
def formatted_results(spark, sf):
    return P.formatted(C.top_k(scored(spark, sf).withColumns({"start_line": F.lit(1), "end_line": F.lit(9)}), 100), 1200)


@query("""WITH o AS (SELECT doc_id AS path, md5(text) AS hash, 'old' AS v FROM documents WHERE lang <> 'de'), n AS (SELECT doc_id AS path, CASE WHEN source = 'src1' THEN md5(text || 'x') ELSE md5(text) END AS hash, 'new' AS v FROM documents WHERE lang <> 'fr')
    SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.hash = n.hash THEN 'old' ELSE 'new' END AS v FROM n LEFT JOIN o USING (path)""")
def incremental_upsert(spark, sf):
    """The table after its changes: rows of changed and new keys are the fresh ones, rows of keys that are gone go."""
    d = S.read(spark, sf, "documents")
    old = d.where("lang <> 'de'").select(F.col("doc_id").alias("path"), F.md5("text").alias("hash"), F.lit("old").alias("v"))
    new = d.where("lang <> 'fr'").select(F.col("doc_id").alias("path"), F.when(F.col("source") == "src1", F.md5(F.concat("text", F.lit("x")))).otherwise(F.md5("text")).alias("hash"), F.lit("new").alias("v"))
    return maintain.upsert(old, new, maintain.diff(old, new)).select("path", "v")


@query("SELECT label, count(*) AS n, round(sum(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) AS size FROM embeddings WHERE label <> 3 GROUP BY 1")
def vectors_deleted(spark, sf):
    """The store after a deletion, as a reader finds it who follows the pointer."""
    v = S.vectors(spark, sf)
    at = new_folder(spark, "vectors")
    s = store.VectorStore(spark, at, "v1")
    s.append(v)
    s.delete(v.where("label = 3"))
    s.publish()
    left = store.VectorStore.active(spark, at).rows()
    return left.join(v.select("chunk_id", "label"), "chunk_id").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum(N.norm("vector")), 6).alias("size"))


@query("WITH e AS (SELECT label AS cid, generate_subscripts(embedding, 1) AS d, unnest(embedding::DOUBLE[]) AS x FROM embeddings), m AS (SELECT cid, d, (avg(x))::FLOAT::DOUBLE AS x FROM e GROUP BY 1, 2) SELECT cid::INT AS cid, round(sum(x), 5) AS total, count(*) AS dims FROM m GROUP BY 1")
def centroid_file(spark, sf):
    """Means written as a NumPy file and read again, in single precision."""
    mean = S.vectors(spark, sf).select("label", F.posexplode("vector").alias("d", "x")).groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    c = mean.groupBy(F.col("label").cast("int").alias("cid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("vector"))
    at = new_folder(spark, "centroids") + ".npy"
    FS.save_centroids(c, at)
    return FS.load_centroids(spark, at).select("cid", F.round(N.total("vector"), 5).alias("total"), F.size("vector").cast("long").alias("dims"))


@query(ORACLE_SQL["pagerank_fixed"])
def centrality_kept(spark, sf):
    """PageRank as a signal that is kept at build time."""
    e = S.edges(spark, sf)
    edges = graph.directed(*(e.where(F.col("kind") == k) for k in ("call", "type_ref", "hierarchy")))
    kept = registry.keep_centrality(new_folder(spark, "signals"), S.nodes(spark, sf), edges, iterations=5, tolerance=0.0)
    return kept.select("chunk_id", F.round(F.col("centrality") * 1000, 6).alias("centrality"))


@query("SELECT 'd' || doc_id AS item, 'q' || doc_id AS query_id, left(text, 20) AS text FROM documents WHERE length(trim(lang, ' ')) > 0")
def evaluation_corpus(spark, sf):
    docs, queries, gold = evaluate.corpus_from_rows(S.read(spark, sf, "documents"), "text", "lang", "doc_id")
    return gold.join(queries, "query_id").drop("text").join(docs, "item").select("item", "query_id", F.left("text", F.lit(20)).alias("text"))


@query("WITH g AS (SELECT doc_id, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT 'q' || doc_id AS query_id, doc_id::VARCHAR AS item FROM g WHERE EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = g.doc_id)")
def evaluation_gold(spark, sf):
    d, r = S.read(spark, sf, "documents"), S.read(spark, sf, "labels")
    corpus = d.select(F.col("doc_id").cast("string").alias("_id"), "text")
    queries = r.select(F.concat(F.lit("q"), "doc_id").alias("_id"), F.lit("x").alias("text")).distinct()
    rel = r.select(F.concat(F.lit("q"), "doc_id").alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), F.col("quality").alias("score"))
    return evaluate.corpus_from_splits(corpus, queries, rel)[2]


@query(ORACLE_SQL["memory_recall"].replace("FROM conversations", "FROM (SELECT * FROM conversations WHERE role = 'user')"))
def recall_in_scope(spark, sf):
    return rounded(relational.recall(S.notes(spark, sf), S.queries(spark, sf), scope="user").select("query_id", "note_id", "score"), 6)


@query(f"WITH {EDGES}, s AS (SELECT 's' || chunk_id AS symbol, chunk_id FROM nodes), r AS (SELECT symbol, CASE kind WHEN 'call' THEN 'callee' ELSE kind END AS relation, dst AS c FROM s JOIN ed ON src = s.chunk_id UNION SELECT symbol, CASE kind WHEN 'call' THEN 'caller' ELSE kind END, src FROM s JOIN ed ON dst = s.chunk_id WHERE kind <> 'call' OR src <> dst), k AS (SELECT *, row_number() OVER (PARTITION BY symbol, relation ORDER BY c) AS k FROM r), "
       "l AS (SELECT symbol, relation, relation || ' (' || count(*) || ')' || chr(10) || string_agg('  n' || c || '  f' || (c % 4) || '.py:1', chr(10) ORDER BY '  n' || c || '  f' || (c % 4) || '.py:1') AS part FROM k WHERE k <= 20 GROUP BY 1, 2) SELECT symbol, string_agg(part, chr(10) ORDER BY relation) AS text FROM l GROUP BY 1")
def formatted_walks(spark, sf):
    n = S.nodes(spark, sf)
    c = n.select("chunk_id", F.concat(F.lit("f"), F.col("chunk_id") % 4, F.lit(".py")).alias("file_path"), F.lit(1).alias("start_line"), F.concat(F.lit("n"), "chunk_id").alias("name"))
    return P.formatted_graph(graph.walk(n.select(F.concat(F.lit("s"), "chunk_id").alias("symbol"), "chunk_id"), S.edges(spark, sf)), c)
