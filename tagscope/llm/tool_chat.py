"""Chat formatting: tool calls linked to their results.

Wire format of a message text: an assistant text may be a JSON object
``{"content": ..., "tool_calls": [{"id", "name", "arguments"}]}`` (arguments: an
object, or JSON text of one) and a tool text ``{"tool_call_id", "content"}``;
anything else is plain content.  An argument value ``{"$result": id}`` stands for
the result of an earlier call, so calls depend on calls.

No text is JSON that holds a number without a finite value (``NaN``, ``1e999``) or
nests deeper than ``DEPTH``.  Lone surrogates, which no UTF-8 text can hold, become
U+FFFD.  Values are walked with a stack of their own.

Parsing, validation and canonical JSON work on one message at a time; linking is
an equi-join on (conversation, identifier).  The topological order is found piece by
piece: the calls of one stretch of turns order themselves in one task as far as they
depend on each other, and a round of joins hands on what the next stretches need; a
chain of calls takes as many rounds as it has stretches, not calls.  One row per
message comes out, so a long conversation is never gathered into one row.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagscope.llm.common import drop_staged, staged

TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
DEPTH = 4000
STRETCH = 4096           # turns whose calls are ordered together
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _whole(text: str) -> str:
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _checked(value, mend: bool):
    """The value, with lone surrogates replaced if ``mend``; raises beyond ``DEPTH``."""
    if not isinstance(value, (dict, list)):
        return _whole(value) if mend and isinstance(value, str) else value
    waiting = [(value, 1)]
    while waiting:
        inside, depth = waiting.pop()
        if depth > DEPTH:
            raise ValueError("nested too deep")
        if mend and isinstance(inside, dict):
            for k in [k for k in inside if _whole(k) != k]:
                inside[_whole(k)] = inside.pop(k)
        for k, v in list(inside.items()) if isinstance(inside, dict) else enumerate(inside):
            if isinstance(v, (dict, list)):
                waiting.append((v, depth + 1))
            elif mend and isinstance(v, str):
                inside[k] = _whole(v)
    return value


def parsed(text: str | None):
    """The JSON value of a text, or None when it is none."""
    def refuse(name):
        raise ValueError(name)

    def finite(number):
        x = float(number)
        return x if math.isfinite(x) else refuse(number)

    if not text or text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        return _checked(json.loads(text, parse_constant=refuse, parse_float=finite), _SURROGATE.search(text) is not None)
    except (ValueError, RecursionError):
        return None


def is_type(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, TYPES.get(kind, object))


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value, by the usual schema words: type, enum, const,
    minimum, maximum, minLength, maxLength, minItems, maxItems, items, required,
    properties, additionalProperties.  A result reference fits any schema."""
    out: list[str] = []
    waiting = [(value, schema, at)]
    while waiting:
        value, schema, at = waiting.pop()
        if schema is None:                               # a finding that waited for its turn
            out.append(value)
            continue
        own, inner = _own_violations(value, schema, at)
        out += own
        waiting += reversed(inner)
    return out


def _own_violations(value, schema: dict, at: str) -> tuple[list[str], list]:
    """A value's own findings, and what is inside it in order: (value, schema, place),
    or a finding with None."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return [], []
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    if kinds and not any(is_type(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"], []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not one of the allowed values")
    if "const" in schema and value != schema["const"]:
        out.append(f"{at}: not the required value")
    if is_type(value, "number"):
        out += [f"{at}: below minimum"] if value < schema.get("minimum", value) else []
        out += [f"{at}: above maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        out += [f"{at}: too short"] if len(value) < schema.get(low, 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get(high, len(value)) else []
    inner: list = []
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        inner += [(v, schema["items"], f"{at}[{i}]") for i, v in enumerate(value)]
    if isinstance(value, dict):
        own, more = schema.get("properties", {}), schema.get("additionalProperties")
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in own:
                inner.append((value[k], own[k], f"{at}.{k}"))
            elif more is False:
                inner.append((f"{at}.{k}: unknown", None, at))
            elif isinstance(more, dict):
                inner.append((value[k], more, f"{at}.{k}"))
    return out, inner


def references(value) -> set[str]:
    found, waiting = set(), [value]
    while waiting:
        inside = waiting.pop()
        if isinstance(inside, dict):
            if set(inside) == {"$result"} and isinstance(inside["$result"], str):
                found.add(inside["$result"])
            else:
                waiting += inside.values()
        elif isinstance(inside, list):
            waiting += inside
    return found


def read_message(role: str | None, text: str | None, schemas: dict) -> dict:
    """content, calls and result_of of one message."""
    value = parsed(text) if role in ("assistant", "tool") else None
    plain = {"content": text, "calls": [], "result_of": None}
    if not isinstance(value, dict):
        return plain
    if role == "tool" and isinstance(value.get("tool_call_id"), str):
        content = value.get("content")
        return plain | {"content": content if isinstance(content, str) else canonical(content), "result_of": value["tool_call_id"]}
    if role != "assistant" or not isinstance(value.get("tool_calls"), list):
        return plain
    calls = []
    for call in value["tool_calls"]:
        call = call if isinstance(call, dict) else {}
        ident, name, given = call.get("id"), call.get("name"), call.get("arguments")
        arguments = parsed(given) if isinstance(given, str) else given
        if not isinstance(arguments, dict):
            errors = ["$: not an object"]
        elif name not in schemas:
            errors = ["unknown tool"]
        else:
            errors = violations(arguments, schemas[name])
        calls.append({"id": ident if isinstance(ident, str) else None, "name": name if isinstance(name, str) else None,
                      "arguments": canonical(arguments), "errors": errors, "needs": sorted(references(arguments))})
    content = value.get("content")
    return {"content": content if isinstance(content, str) else None, "calls": calls, "result_of": None}


CALL = "struct<id:string,name:string,arguments:string,errors:array<string>,needs:array<string>>"
CALL_TYPE = pa.struct([("id", pa.string()), ("name", pa.string()), ("arguments", pa.string()),
                       ("errors", pa.list_(pa.string())), ("needs", pa.list_(pa.string()))])


def order_stretch(table: pa.Table) -> pa.Table:
    """Levels of the calls of one stretch that can be told: rows (conv, stretch, id,
    need, inside, known) are their needs, ``inside`` if the needed call lies in the
    stretch and is open too, else with its level (null: not known yet)."""
    waits: dict[str, set] = {}
    level: dict[str, int] = {}
    users: dict[str, list] = {}
    for ident, need, inside, known in zip(*[table.column(c).to_pylist() for c in ("id", "need", "inside", "known")]):
        w = waits.setdefault(ident, set())
        if known is not None:
            level[ident] = max(level.get(ident, 0), known + 1)
        else:
            w.add(need)                       # outside and unknown: nobody takes it away in this round
            if inside:
                users.setdefault(need, []).append(ident)
    ready, done = [i for i, w in waits.items() if not w], []
    while ready:
        ident = ready.pop()
        done.append(ident)
        for user in users.get(ident, ()):
            level[user] = max(level.get(user, 0), level.get(ident, 0) + 1)
            waits[user].discard(ident)
            if not waits[user]:
                ready.append(user)
    conv = table.column("conv")[:1].to_pylist() * len(done)
    return pa.table({"conv": pa.array(conv, table.schema.field("conv").type), "id": pa.array(done, pa.string()),
                     "level": pa.array([level.get(i, 0) for i in done], pa.int32())})


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv, id, level): 0 for calls that need no other call, else one more
    than the highest level among the calls needed; calls on a cycle, or that
    need one, get null.

    ``calls`` (conv, id, stretch); ``needs`` (conv, id, need).  In each round every
    stretch orders its open calls as far as their needs are known; rounds end when
    none is settled.  A group holds the calls of one stretch of turns."""
    keys = ["conv", "id"]
    kinds = dict(calls.dtypes)
    place = calls.select("conv", F.col("id").alias("need"), F.col("stretch").alias("need_stretch"))
    edges = staged(needs.join(place, ["conv", "need"]).join(calls, keys).distinct(), "chat-needs")
    done = staged(calls.select(*keys).join(edges.select(*keys).distinct(), keys, "left_anti").withColumn("level", F.lit(0)), "chat-levels")
    while True:
        known = done.select("conv", F.col("id").alias("need"), F.col("level").alias("known"))
        # the needs of calls that are settled already have done their work
        open_ = edges.join(done.select(*keys), keys, "left_anti").join(known, ["conv", "need"], "left") \
            .withColumn("inside", F.col("need_stretch") == F.col("stretch"))
        fresh = staged(open_.groupBy("conv", "stretch").applyInArrow(order_stretch, f"conv {kinds['conv']}, id string, level int"), "chat-levels")
        if fresh.isEmpty():
            drop_staged(edges)
            return done
        longer = staged(done.unionByName(fresh), "chat-levels")
        drop_staged(done)
        drop_staged(fresh)
        done = longer


def format_chats(messages: DataFrame, schemas: dict[str, dict], conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row per message: conv_id, turn, role, level, n_calls, n_linked,
    n_invalid, status, json.

    ``json`` is the message as canonical JSON; its calls stand in topological
    order (level, then place).  ``level`` is the highest level among a message's
    calls, or of the call whose result it is.  ``status`` of a tool message:
    linked, early (its call comes in a later turn) or orphan; of an assistant
    message with calls: linked when all calls have a result, open when some have
    none, cyclic when a call waits for itself; other messages: plain.

    Calls and results that repeat an identifier are matched in turn order, the
    first with the first.  Calls without an identifier, and messages of a null
    conversation, link to nothing.  Null texts have null content; texts that are
    no JSON of the wire format are plain content.  Rows that repeat (conv, turn)
    are told apart by role and text, equal rows give equal results.  Extra
    columns are not read.  An empty table gives no rows.
    """
    rows = messages.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    types = dict(rows.dtypes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [read_message(r, t, schemas) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array([g["content"] for g in got], pa.string()),
                pa.array([g["calls"] for g in got], pa.list_(CALL_TYPE)), pa.array([g["result_of"] for g in got], pa.string())],
                names=["conv", "turn", "role", "content", "calls", "result_of"])

    said = rows.mapInArrow(read, f"conv {types['conv']}, turn {types['turn']}, role string, content string, calls array<{CALL}>, result_of string")
    said = staged(said.withColumn("msg", F.xxhash64("conv", "turn", "role", "content", "calls", "result_of")), "chat-messages")

    calls = said.where(F.size("calls") > 0).dropDuplicates(["conv", "turn", "msg"]) \
        .select("conv", "turn", "msg", F.posexplode("calls").alias("place", "call")).select("conv", "turn", "msg", "place", "call.*")
    named = calls.where("id is not null and conv is not null")
    results = said.where("result_of is not null and conv is not null").dropDuplicates(["conv", "turn", "msg"]) \
        .select("conv", F.col("turn").alias("result_turn"), F.col("msg").alias("result_msg"), F.col("result_of").alias("id"))

    def numbered(df, *order):
        return df.withColumn("nth", F.row_number().over(Window.partitionBy("conv", "id").orderBy(*order)))

    linked = numbered(named, "turn", "msg", "place").join(numbered(results, "result_turn", "result_msg"), ["conv", "id", "nth"], "full_outer")
    stretch = F.floor(F.coalesce(F.col("turn").try_cast("double"), F.lit(0.0)) / STRETCH).try_cast("long")
    places = named.groupBy("conv", "id").agg(F.min(stretch).alias("stretch"))
    at = levels(places, named.select("conv", "id", F.explode("needs").alias("need")))
    linked = staged(linked.join(at, ["conv", "id"], "left"), "chat-links")

    by_call = linked.where("msg is not null").select("conv", "turn", "msg", "place", "level", (F.col("result_turn").isNotNull()).alias("has_result"))
    per_message = by_call.groupBy(F.col("conv").alias("_conv"), F.col("turn").alias("_turn"), F.col("msg").alias("_msg")).agg(
        F.collect_list(F.struct("place", "level", "has_result")).alias("marks"))   # bounded by the message's own text
    per_result = linked.where("result_msg is not null").select(
        F.col("conv").alias("_rconv"), F.col("result_turn").alias("_rturn"), F.col("result_msg").alias("_rmsg"), F.col("name").alias("tool_name"),
        F.col("level").alias("result_level"), F.when(F.col("msg").isNull(), "orphan").when(F.col("result_turn") < F.col("turn"), "early")
        .otherwise("linked").alias("result_status"))
    joined = said.join(per_message, (F.col("conv") == F.col("_conv")) & (F.col("turn").eqNullSafe(F.col("_turn"))) & (F.col("msg") == F.col("_msg")), "left") \
        .join(per_result, (F.col("conv") == F.col("_rconv")) & (F.col("turn").eqNullSafe(F.col("_rturn"))) & (F.col("msg") == F.col("_rmsg")), "left")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                marks = {m["place"]: m for m in r["marks"] or []}
                calls = r["calls"] or []
                order = sorted(range(len(calls)), key=lambda i: (
                    lev if (lev := marks.get(i, {}).get("level")) is not None else 1 << 30, i))
                # arguments are canonical already; keys in sorted order
                message = [f'"content":{canonical(r["content"])}']
                if r["result_of"] is not None:
                    message.append(f'"name":{canonical(r["tool_name"])}')
                message.append(f'"role":{canonical(r["role"])}')
                if r["result_of"] is not None:
                    message.append(f'"tool_call_id":{canonical(r["result_of"])}')
                if calls:
                    message.append('"tool_calls":[' + ",".join(
                        f'{{"arguments":{calls[i]["arguments"]},"id":{canonical(calls[i]["id"])},"name":{canonical(calls[i]["name"])}}}'
                        for i in order) + "]")
                n_linked = sum(bool(m["has_result"]) for m in marks.values())
                status, level = "plain", None
                if calls:
                    found = [m["level"] for m in marks.values()]
                    level = max((x for x in found if x is not None), default=None)
                    status = "cyclic" if None in found else "linked" if n_linked == len(calls) else "open"
                elif r["result_of"] is not None:
                    status, level = r["result_status"] or "orphan", r["result_level"]
                out.append((level, len(calls), n_linked, sum(bool(c["errors"]) for c in calls), status, "{" + ",".join(message) + "}"))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                                             names=["conv_id", "turn", "role", "level", "n_calls", "n_linked", "n_invalid", "status", "json"])

    return joined.select("conv", "turn", "role", "content", "calls", "result_of", "marks", "tool_name", "result_level", "result_status").mapInArrow(
        write, f"conv_id {types['conv']}, turn {types['turn']}, role string, level int, n_calls int, n_linked int, n_invalid int, status string, json string")


# ---- tool transcripts made of ordinary conversations ------------------------------

ANSWER_SCHEMA = {"answer": {
    "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
    "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}, "after": {"type": "string"}}}}


ODD_TURNS = 16


def as_tool_transcript(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                       chain: int = 4) -> DataFrame:
    """Conversations in the wire format: a user turn becomes a call of the tool
    ``answer`` with the prompt, and the assistant turn after it that call's
    result.  A call refers to the result of the user turn two before it, but for
    every ``chain``-th, so dependencies are real and their chains short.

    One in ``ODD_TURNS`` each, by a hash of conversation and turn, does it wrong: a call
    with a negative turn and a word too much, one that waits for itself, one with the
    identifier of the call before it; a result of nothing, and one of the call that
    comes after it."""
    c, t, x = F.col(conv).cast("string"), F.col(turn), F.coalesce(F.col(text), F.lit(""))
    odd = F.pmod(F.xxhash64(c, t.cast("string")), F.lit(ODD_TURNS))

    def ident(n):
        return F.concat(F.lit("c"), c, F.lit("-"), n.cast("string"))

    after = F.when(odd == 1, F.struct(ident(t).alias("$result"))).when(F.pmod(F.floor(t / 2), F.lit(chain)) != 0, F.struct(ident(t - 2).alias("$result")))
    arguments = F.struct(x.alias("prompt"), F.when(odd == 0, -1 - t).otherwise(t).alias("turn"), after.alias("after"),
                         F.when(odd == 0, F.lit("?")).alias("mood"))
    own = F.when(odd == 2, ident(t - 2)).otherwise(ident(t))
    call = F.struct(F.lit("").alias("content"), F.array(F.struct(own.alias("id"), F.lit("answer").alias("name"), arguments.alias("arguments"))).alias("tool_calls"))
    of = F.when(odd == 3, F.lit("nothing")).when(odd == 4, ident(t + 1)).otherwise(ident(t - 1))
    result = F.struct(of.alias("tool_call_id"), x.alias("content"))
    return conversations.select(
        conv, turn, F.when(F.col(role) == "user", "assistant").when(F.col(role) == "assistant", "tool").otherwise(F.col(role)).alias(role),
        F.when(F.col(role) == "user", F.to_json(call)).when(F.col(role) == "assistant", F.to_json(result)).otherwise(F.col(text)).alias(text))
