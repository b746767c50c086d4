"""Chat formatting: links tool calls to their results, orders them, validates arguments and writes canonical JSON.

Calls and results meet in a hash join on the identifier. Order: edges that a path of two others implies are dropped, so calls
that each follow the last few become a chain; chains of calls with one predecessor are contracted by pointer doubling, so a
chain of n calls takes about log2(n) rounds; what is left, calls with several predecessors, is peeled level by level, and each
edge is written once. No conversation is gathered in one task. Arguments are parsed as variants, which keep JSON's types."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, staged, table

#: Schemas of the calls that conversations stand for: argument -> (type, required, least).
#: `least` is the smallest value of an integer or number, or the shortest length of a string.
SCHEMAS = {"configure": {"prompt": ("string", True, 1), "turn": ("integer", True, 0)}, "reply": {"prompt": ("string", True, 1), "turn": ("integer", True, 0)}}

#: JSON type -> the names under which variants know it.
TYPES = {"string": r"^STRING$", "boolean": r"^BOOLEAN$", "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE)$"}


def quoted(c: Column) -> Column:
    """A string as JSON."""
    text = F.to_json(F.array(c))
    return F.substring(text, 2, F.length(text) - 2)


def without_implied(edges: DataFrame, calls: DataFrame, few: int = 8) -> DataFrame:
    """edges without those from x to z for which edges from x to y and from y to z are there, with falling turns, and y has at most
    `few` predecessors. The longest chains and the cycles stay: what an edge stood for, a longer path of kept edges still does."""
    turns = calls.select("call_id", "turn")
    timed = edges.join(turns, "call_id").join(turns.toDF("dep", "dep_turn"), "dep").filter("dep_turn < turn").select("call_id", "dep")
    narrow = timed.groupBy("call_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") <= few).select("call_id")
    second = timed.join(narrow, "call_id").select(F.col("call_id").alias("via"), "dep")
    implied = timed.withColumnRenamed("dep", "via").join(second, "via").select("call_id", "dep").distinct()
    return edges.join(implied, ["call_id", "dep"], "left_anti")


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """calls: call_id, distinct, and turn. edges: call_id, dep, both calls. One row for each call: call_id, level, the length of
    the longest chain of calls before it; null for calls on a cycle or after one."""
    edges = staged(without_implied(edges.select("call_id", "dep").distinct(), calls), "calls-edges")
    degree = edges.groupBy("call_id").agg(F.count(F.lit(1)).alias("k"), F.min("dep").alias("only"))
    nodes = calls.select("call_id").join(degree, "call_id", "left")
    chain = F.col("k") == 1
    ptr = staged(nodes.select("call_id", F.when(chain, F.col("only")).otherwise(F.col("call_id")).alias("at"), F.when(chain, 1).otherwise(0).cast("long").alias("far"), F.coalesce(F.col("k"), F.lit(0)).alias("k")), "calls-chain")
    rounds, most = 0, max(1, ptr.count()).bit_length() + 1
    while rounds < most:
        step = ptr.select(F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"))
        new = staged(ptr.join(step, "at").select("call_id", F.col("next").alias("at"), (F.col("far") + F.col("more")).alias("far"), "k", (F.col("more") > 0).alias("moved")), "calls-chain")
        discard(ptr)
        ptr, rounds = new, rounds + 1
        if new.filter("moved").isEmpty():
            break
    ends = ptr.filter("call_id = at").select(F.col("call_id").alias("at"))  # roots and calls with several predecessors
    ptr = staged(ptr.join(ends, "at", "left_semi").select("call_id", "at", "far", "k"), "calls-chain")  # the rest runs into a cycle
    done = [ptr.filter("k = 0").select("call_id", F.lit(0).cast("long").alias("level"))]
    open_ = ptr.filter("k > 1").select("call_id", "k")
    if not open_.isEmpty():
        into = staged(open_.join(edges, "call_id").join(ptr.select(F.col("call_id").alias("dep"), "at", "far"), "dep", "left").select("call_id", "k", "at", "far"), "calls-joins")
        reached: list[DataFrame] = []
        while True:
            last = done[-1].select(F.col("call_id").alias("at"), "level")
            new = staged(into.join(last, "at").select("call_id", "k", (F.col("level") + F.col("far") + 1).alias("level")), "calls-reached")
            if new.isEmpty():
                break
            reached = together([*reached, new])
            so_far = reduce(DataFrame.unionByName, reached).join(new.select("call_id").distinct(), "call_id", "left_semi")
            ready = so_far.groupBy("call_id").agg(F.first("k").alias("k"), F.count(F.lit(1)).alias("got"), F.max("level").alias("level")).filter("got = k")
            done = [*together(done), staged(ready.select("call_id", "level"), "calls-levels")]
    all_done = reduce(DataFrame.unionByName, done)
    return ptr.join(all_done.select(F.col("call_id").alias("at"), "level"), "at").select("call_id", (F.col("level") + F.col("far")).alias("level"))


def together(parts: list[DataFrame], most: int = 24) -> list[DataFrame]:
    """The parts, written as one table when they are many."""
    return parts if len(parts) < most else [staged(reduce(DataFrame.unionByName, parts), "calls-parts")]


#: A run of digits that may be longer than the 38 that a variant keeps exactly, and a number with an exponent; both may as well be part of a string.
LONG_RUN, WITH_EXPONENT = r"[0-9][0-9.]{38}", r"[0-9][eE][-+]?[0-9]"
STRINGS_AND_REST, NUMBERS_AND_REST = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"]+|"', r"[-+.0-9eE]+|[^-+.0-9eE]+"


def in_numbers(text: Column, change) -> Column:
    """The pieces of a JSON text, its strings as they are and its numbers changed."""
    tokens = lambda piece: F.array_join(F.transform(F.regexp_extract_all(piece, F.lit(NUMBERS_AND_REST), F.lit(0)), change), "")
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(STRINGS_AND_REST), F.lit(0)), lambda p: F.when(p.startswith('"'), p).otherwise(tokens(p))), "")


def plain_number(token: Column) -> Column:
    """A number with an exponent without it, where it is one of 20 digits before the point and 18 after it; anything else as it is."""
    value = token.try_cast("decimal(38,18)")
    plain = F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    same = token.rlike(r"^-?[0-9]+(\.[0-9]+)?[eE][-+]?[0-9]+$") & (value.cast("double") == token.try_cast("double"))
    return F.when(same, F.when(value == 0, "0").otherwise(plain)).otherwise(token)


def inexact(text: Column) -> Column:
    """Whether a JSON text holds a number of more digits than 38, which no type here keeps."""
    rest = F.array_join(F.filter(F.regexp_extract_all(text, F.lit(STRINGS_AND_REST), F.lit(0)), lambda p: ~p.startswith('"')), " ")
    return F.when(text.rlike(LONG_RUN), rest.rlike(LONG_RUN)).otherwise(False)


def parsed_arguments(text: Column) -> tuple[Column, Column]:
    """The variant of a text that is one JSON value and no more, else null; and why it is null though the text begins with a JSON object.

    The text is parsed as the first element of an array whose second is a digest of it, so what follows the value can't be taken for the end."""
    seal = F.md5(text)
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))
    alone = F.try_variant_get(whole, "$[1]", "string") == seal
    value = F.when(alone & ~inexact(text), F.try_variant_get(whole, "$[0]", "variant"))
    why = F.when(F.coalesce(alone, F.lit(False)), "inexact number").when(F.try_parse_json(text).isNull(), "duplicate key").otherwise("trailing text")
    return value, why


def problems(name: Column, text: Column, parsed: Column, why: Column, schemas: dict) -> Column:
    """Errors of a call's arguments (parsed_arguments() of their text) against its schema. Arguments that can't be read have that one error."""
    keys, out = F.json_object_keys(text), F.array(F.lit("unknown tool"))
    of_any = [F.when(keys.isNull(), "not an object"), F.when(keys.isNotNull() & parsed.isNull(), why)]
    for tool, schema in sorted(schemas.items()):
        known = F.array(*[F.lit(a) for a in sorted(schema)])
        found = [*of_any, F.when(parsed.isNotNull() & (F.size(F.array_except(keys, known)) > 0), "unknown argument")]
        for a, (kind, required, least) in sorted(schema.items()):
            path = f"$['{a}']"
            value = F.try_variant_get(parsed, path, {"string": "string", "boolean": "boolean", "integer": "decimal(38,0)", "number": "double"}[kind])
            there, typed = F.array_contains(keys, a), F.schema_of_variant(F.try_variant_get(parsed, path, "variant")).rlike(TYPES[kind])
            fits = F.coalesce(typed & value.isNotNull() & (F.abs(value) < float("inf") if kind == "number" else F.lit(True)), F.lit(False))
            if required:
                found.append(F.when(parsed.isNotNull() & ~there, f"{a}: missing"))
            found.append(F.when(parsed.isNotNull() & there & ~fits, f"{a}: not {kind}"))
            if kind != "boolean":
                found.append(F.when(there & fits & ((F.length(value) if kind == "string" else value) < least), f"{a}: below {least}"))
        out = F.when(name == tool, F.array_compact(F.array(*found))).otherwise(out)
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, edges: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """calls: call_id, conv_id, turn, name, arguments (JSON text); results: call_id, content; edges: call_id, dep.

    One row for each call_id: conv_id, call_id, turn, name, level, n_results, errors (joined by "; ", empty if valid), json.
    (level, turn, call_id) orders a conversation topologically; level is null on or after a cycle, an error of its own. Results
    whose call is not there are returned as rows with the error "no call" and without conv_id, turn, name and level.
    Of repeated calls or results with one id the smallest counts; n_results tells how many there were. Calls and results without
    an id and edges to unknown calls are left out. A null content counts as a result. Other columns are not read.

    Types are JSON's: a number is no string, a present null is of no type but there, 1.0 and 1e2 are integers. The JSON has sorted keys
    at every depth, no spaces, and numbers in their shortest form without an exponent where 38 digits hold them; no number changes its
    value, but for fractions with an exponent beyond these, which are taken as doubles. Arguments that are no JSON, are followed by
    other text, hold a key twice at any depth (no value may be chosen) or a number of over 38 digits have that one error, and are given as a string."""
    one = calls.filter("call_id is not null").groupBy("call_id").agg(F.min(F.struct("conv_id", "turn", "name", "arguments")).alias("c")).select("call_id", "c.*")
    one = staged(one, "calls")
    known = one.select("call_id")
    edges = edges.select("call_id", "dep").join(known, "call_id", "left_semi").join(known.withColumnRenamed("call_id", "dep"), "dep", "left_semi")
    answers = results.filter("call_id is not null").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_results"), F.min("content").alias("content"))
    value, why = parsed_arguments(F.when(F.col("arguments").rlike(WITH_EXPONENT), in_numbers(F.col("arguments"), plain_number)).otherwise(F.col("arguments")))
    placed = one.join(levels(one, edges), "call_id", "left").withColumns({"parsed": value, "why": why, "called": F.lit(True)})
    joined = placed.join(answers, "call_id", "full")
    errors = F.concat(problems(F.col("name"), F.col("arguments"), F.col("parsed"), F.col("why"), schemas), F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")))
    null = F.lit("null")
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("parsed"), quoted(F.col("arguments")), null), F.lit(',"id":'), quoted(F.col("call_id")),
        F.lit(',"name":'), F.coalesce(quoted(F.col("name")), null), F.lit(',"result":'), F.coalesce(quoted(F.col("content")), null), F.lit("}"),
    )
    said = F.when(F.col("called"), F.concat_ws("; ", F.array_sort(errors))).otherwise("no call")
    return joined.select("conv_id", "call_id", "turn", "name", "level", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), said.alias("errors"), json.alias("json"))


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reads turns (conv_id, turn, role, text) as calls: a turn of the assistant is the result of the turn before it, any other
    turn is a call (`configure` for the system's, else `reply`) that follows the calls of the two turns before it."""
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    named = lambda n: F.concat(F.lit("call-"), F.col("conv_id").cast("string"), F.lit("-"), n.cast("string"))
    asks = ~F.coalesce(F.col("role") == "assistant", F.lit(False))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    calls = base.filter(asks).select(named(F.col("turn")).alias("call_id"), "conv_id", "turn", F.when(F.col("role") == "system", "configure").otherwise("reply").alias("name"), arguments.alias("arguments"))
    results = base.filter(~asks).select(named(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    edges = calls.select("call_id", "conv_id", F.explode(F.array(F.col("turn") - 1, F.col("turn") - 2)).alias("before")).select("call_id", named(F.col("before")).alias("dep"))
    return calls, results, edges


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(*from_conversations(table(spark, sf_dir, "conversations")))


ORACLE = r"""
WITH RECURSIVE c AS (SELECT 'call-' || conv_id || '-' || turn AS call_id, conv_id, turn, min(struct_pack(name := CASE WHEN role = 'system' THEN 'configure' ELSE 'reply' END, txt := text)) AS s
 FROM conversations WHERE coalesce(role, '') <> 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
r AS (SELECT 'call-' || conv_id || '-' || (turn - 1) AS call_id, count(*) AS n_results, min(text) AS content FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
e AS (SELECT a.call_id, b.call_id AS dep FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn IN (a.turn - 1, a.turn - 2)),
w AS (SELECT call_id, CAST(0 AS BIGINT) AS l FROM c UNION SELECT e.call_id, w.l + 1 FROM w JOIN e ON e.dep = w.call_id),
v AS (SELECT call_id, max(l) AS level FROM w GROUP BY call_id)
SELECT conv_id, call_id, turn, s.name AS name, level, coalesce(n_results, 0) AS n_results,
 CASE WHEN s.txt IS NULL THEN 'prompt: missing' WHEN s.txt = '' THEN 'prompt: below 1' ELSE '' END AS errors,
 '{"arguments":{' || CASE WHEN s.txt IS NULL THEN '' ELSE '"prompt":' || CAST(to_json(s.txt) AS VARCHAR) || ',' END || '"turn":' || turn || '},"id":"' || call_id || '","name":"' || s.name || '","result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM c JOIN v USING (call_id) LEFT JOIN r USING (call_id)
UNION ALL SELECT NULL, call_id, NULL, NULL, NULL, n_results, 'no call', '{"arguments":null,"id":"' || call_id || '","name":null,"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}'
FROM r WHERE call_id NOT IN (SELECT call_id FROM c)
"""
