"""Read-only SQL over a graph: a query is parsed by Spark and its plan checked before it runs."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import MARKED, PLAIN, redaction_sql
from loomgraph.operators import fulltext, lookup
from loomgraph.operators.fulltext import TextIndex
from loomgraph.schema import QUERY_CHARS, QUERY_ROWS, TABLES
from loomgraph.store import GraphStore

ALLOWED = {"Project", "Filter", "Join", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "UnresolvedRelation", "SubqueryAlias", "Distinct", "Intersect", "Except", "UnresolvedHaving", "WithWindowDefinition", "Offset", "UnresolvedInlineTable"}
#: Functions that a query may call: sums, windows, text, numbers, times, JSON; none that reaches out of the engine.
FUNCTIONS = set(
    """
    count sum min max avg mean count_if any_value first last stddev variance median percentile mode collect_list collect_set max_by min_by bool_and bool_or
    row_number rank dense_rank percent_rank cume_dist ntile lag lead first_value last_value nth_value
    coalesce nullif nvl ifnull if greatest least isnull isnotnull
    lower upper trim ltrim rtrim length char_length substr substring left right replace concat concat_ws split split_part instr locate startswith endswith contains
    lpad rpad reverse repeat regexp_like regexp_extract regexp_replace regexp_count like ilike
    abs sign round bround floor ceil ceiling sqrt power pow exp ln log log10 mod pmod
    array size element_at array_contains array_distinct array_sort array_min array_max array_size array_join
    between string_agg listagg
    get_json_object json_array_length json_object_keys json_extract
    current_timestamp current_date now extract date_part date_format make_date make_timestamp timestampadd timestampdiff months_between last_day strftime datetime
    date year month day dayofweek hour minute second date_trunc trunc datediff date_add date_sub to_date to_timestamp unix_timestamp timestamp string int bigint double boolean
    normalize_name redact
    """.split()
)
#: The table of the full-text index.
INDEX = "nodes_fts"
# Signs of strftime and Spark's patterns for them.
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%j": "DDD"}
# Words that the strict rules refuse anywhere in the text.
STRICT = ("union", "insert", "update", "delete", "drop", "create", "alter", "replace")


#: A text of a query, a quoted name, or a comment; what is between them is the rest.
QUOTED = re.compile(r"('(?:[^'\\\\]|\\\\.|'')*'|\"(?:[^\"\\\\]|\\\\.)*\"|`[^`]*`|--[^\n]*|/\*(?s:.*?)\*/)")
MATCH = re.compile(r"([A-Za-z_][\w.]*)\s+MATCH\s*$", re.I)


def nodes_of(plan):
    yield plan
    children = plan.children()
    for k in range(children.size()):
        yield from nodes_of(children.apply(k))


def is_subquery(part) -> bool:
    kind = part.getClass()
    while kind is not None:
        if kind.getSimpleName() in ("PlanExpression", "SubqueryExpression", "InSubquery"):
            return True
        kind = kind.getSuperclass()
    return False


def rewritten(query: str) -> tuple[str, list[tuple[str, str]]]:
    """The query with the words of the older dialect in Spark's: LIKE is blind to case, group_concat is a string_agg with a comma, and
    `nodes_fts MATCH 'words'` is a call fts_match(nodes_fts, k) of the k-th search. And the searches: what is searched and for what."""
    parts = QUOTED.split(query)
    searches: list[tuple[str, str]] = []
    for k in range(0, len(parts) - 1, 2):
        m = MATCH.search(parts[k])
        if m and parts[k + 1][0] in "'\"":
            if m.group(1).split(".")[-1].lower() != "nodes_fts":
                raise ValueError("only nodes_fts can be matched")
            words = parts[k + 1][1:-1].replace("''", "'")
            if re.search(r"[*\"^:+()-]|\b(OR|NOT|NEAR)\b", words):
                raise ValueError("a search is of words that must all be there")
            searches.append((m.group(1), words))
            parts[k] = parts[k][: m.start()] + f"fts_match({m.group(1)}, {len(searches) - 1})"
            parts[k + 1] = ""
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r"\bLIKE\b", "ILIKE", parts[k], flags=re.I)
    return with_string_agg("".join(parts)), searches


def with_string_agg(query: str) -> str:
    """group_concat(x) as string_agg(cast(x as string), ','), group_concat(x, y) with y in place of the comma."""
    while m := re.search(r"\bgroup_concat\s*\(", query, re.I):
        depth, comma, k, quote = 1, None, m.end(), ""
        while depth and k < len(query):
            c = query[k]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            elif c == "," and depth == 1:
                comma = k
            depth += 0 if quote else (c == "(") - (c == ")")
            k += 1
        if depth:
            raise ValueError("a bracket is not closed")
        inner = query[m.end() : comma if comma else k - 1]
        first = re.match(r"\s*DISTINCT\b", inner, re.I)
        inner = f"DISTINCT CAST({inner[first.end():]} AS STRING)" if first else f"CAST({inner} AS STRING)"
        query = query[: m.start()] + f"string_agg({inner}, {query[comma + 1 : k - 1] if comma else chr(39) + ',' + chr(39)})" + query[k:]
    return query


def check(store: GraphStore, query: str, strict: bool = False) -> None:
    """ValueError unless the query is a SELECT over the graph's tables, of joins, filters, groups, windows and sorts.
    strict: also refuse by words of the text, as callers of the older rules expect."""
    if not isinstance(query, str) or not query.strip():
        raise ValueError("a query is needed")
    if len(query) > QUERY_CHARS:
        raise ValueError(f"a query has {QUERY_CHARS} characters at most")
    text = query.strip().lower()
    if not text.startswith("select"):
        raise ValueError("only SELECT is allowed")
    if strict and (any(w in text for w in STRICT) or re.search(r"\( ?select", text)):
        raise ValueError("this word is not allowed")
    spark = store.nodes.sparkSession
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(rewritten(query)[0])
    except ValueError:
        raise
    except Exception as e:
        raise ValueError("the query can not be read") from e
    for node in nodes_of(plan):
        name = node.getClass().getSimpleName()
        if name not in ALLOWED:
            raise ValueError(f"{name} is not allowed")
        if name == "UnresolvedRelation" and node.multipartIdentifier().mkString(".").lower() not in {*TABLES, INDEX}:
            raise ValueError("this table is not allowed")
        expressions = node.expressions()
        for k in range(expressions.size()):
            for part in nodes_of(expressions.apply(k)):
                called = part.getClass().getSimpleName() == "UnresolvedFunction" and part.nameParts().mkString(".").lower()
                if called and called not in FUNCTIONS and called != "fts_match":
                    raise ValueError(f"the function {called} is not allowed")
                if is_subquery(part):
                    raise ValueError("subqueries are not allowed")


def query(store: GraphStore, text: str, limit: int | None = 100, strict: bool = False, index: TextIndex | None = None) -> DataFrame:
    """The query's rows, limit at most; None: all of them, for callers that read them as a table. nodes_fts has the columns rowid, name, qualified_name and properties, and one of its own name, for
    MATCH; index: the stored index that answers that, else all nodes are read."""
    if limit is not None and (not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= QUERY_ROWS):
        raise ValueError(f"limit is 1 to {QUERY_ROWS}")
    check(store, text, strict)
    try:
        found = run(store, text, index)
        return found if limit is None else found.limit(limit)
    except (AnalysisException, ParseException, Py4JJavaError) as e:
        raise ValueError("the query can not be run: " + str(e).split("\n")[0][:200]) from e


def run(store: GraphStore, text: str, index: TextIndex | None = None) -> DataFrame:
    """The query over the store's tables; views of the session that have their names are there again afterwards."""
    spark = store.nodes.sparkSession
    text, searches = rewritten(text)
    views = store.views()
    if re.search(rf"\b{INDEX}\b", text, re.I):
        views[INDEX] = store.nodes.select(F.col("id").alias("rowid"), "name", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), "properties", F.col("id").alias(INDEX))
    for k, (column, words) in enumerate(searches):
        hits = fulltext.search(index, store, words, None, None) if index else lookup.search(store, words, None, None)
        views[f"{INDEX}_{k}"] = hits.select("id")
        text = text.replace(f"fts_match({column}, {k})", f"{column} IN (SELECT id FROM {INDEX}_{k})")
    before = {name: spark.table(name) for name in views if spark.catalog._jcatalog.tableExists(name)}
    register_functions(spark)
    try:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
        return spark.sql(text)
    finally:
        for name in views:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)


def register_functions(spark: SparkSession) -> None:
    """Functions of the session's SQL: normalize_name(text) for names of Latin letters, redact(text), and those of the older dialect:
    json_extract(json, path), strftime(format, time), datetime(time or 'now', change)."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION normalize_name(name STRING) RETURNS STRING RETURN
        coalesce(nullif(regexp_replace(regexp_replace(translate(lower(trim(name)), '%s', '%s'), '[^a-z0-9]+', '-'), '^-+|-+$', ''), ''), if(name IS NULL, NULL, 'node'))""" % (MARKED, PLAIN))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION redact(words STRING) RETURNS STRING RETURN {redaction_sql('words')}")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION json_extract(json STRING, path STRING) RETURNS STRING RETURN get_json_object(json, path)")
    form = "format"
    for sign, pattern in STRFTIME.items():
        form = f"replace({form}, '{sign}', '{pattern}')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION strftime(format STRING, time TIMESTAMP) RETURNS STRING RETURN date_format(time, {form})")
    number, unit = (f"regexp_extract(change, '^ *([+-]?[0-9]+) *(second|minute|hour|day|month|year)s? *$', {k})" for k in (1, 2))
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION datetime(time STRING, change STRING DEFAULT '+0 days') RETURNS TIMESTAMP RETURN
        if(time = 'now', current_timestamp(), CAST(time AS TIMESTAMP)) + CAST(nullif({number}, '') || ' ' || nullif({unit}, '') AS INTERVAL)""")
