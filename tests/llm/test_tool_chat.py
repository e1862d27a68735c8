import json

from tagscope.llm import queries, tool_chat
from tests.llm.conftest import SF

SCHEMAS = {"f": {"type": "object", "properties": {"x": {"type": "integer", "minimum": 0}}, "required": ["x"], "additionalProperties": False}}
SCHEMA = "conv_id long, turn long, role string, text string, level string, json string"


def calls(*given, content="hi"):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in given]})


def result(ident, content):
    return json.dumps({"tool_call_id": ident, "content": content})


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(tool_chat.format_chats(df, SCHEMAS).collect(), key=lambda r: (str(r.conv_id), str(r.turn), r.json))


def test_links_order_and_status(spark):
    ref = {"$result": "a"}
    got = run(spark, [(1, 0, "assistant", calls(("b", "f", {"x": ref}), ("a", "f", '{"x": 1}'))), (1, 1, "tool", result("a", {"z": 1, "a": "é"})),
                      (1, 2, "tool", result("b", "two")), (1, 3, "tool", result("zz", None))])
    first, a, b, orphan = got
    assert (first.status, first.level, first.n_calls, first.n_linked, first.n_invalid) == ("linked", 1, 2, 2, 0)
    assert first.json == ('{"content":"hi","role":"assistant","tool_calls":[{"arguments":{"x":1},"id":"a","name":"f"},'
                          '{"arguments":{"x":{"$result":"a"}},"id":"b","name":"f"}]}')
    assert (a.status, a.level, a.json) == ("linked", 0, '{"content":"{\\"a\\":\\"é\\",\\"z\\":1}","name":"f","role":"tool","tool_call_id":"a"}')
    assert (b.status, b.level) == ("linked", 1) and orphan.status == "orphan"


def test_cycles_early_results_and_repeats(spark):
    got = run(spark, [(2, 0, "assistant", calls(("p", "f", {"x": {"$result": "q"}}), ("q", "f", {"x": {"$result": "p"}}))),
                      (3, 0, "tool", result("a", "soon")), (3, 1, "assistant", calls(("a", "f", {"x": -1}))),
                      (4, 0, "assistant", calls(("a", "f", {"x": 1}))), (4, 1, "assistant", calls(("a", "f", {"x": 2}))), (4, 2, "tool", result("a", "1"))])
    assert [r.status for r in got] == ["cyclic", "early", "linked", "linked", "open", "linked"]
    assert got[2].n_invalid == 1


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 0, "assistant", calls(("a", "f", {"x": 1}))), (5, 0, "assistant", ""), (5, 1, "assistant", "{broken"),
            (5, 2, "assistant", '{"tool_calls": [1, {"id": 3}, {"id": "k", "arguments": "[1]"}]}'), (5, 3, "tool", '{"tool_call_id": 4}'),
            (5, 4, "user", calls(("a", "f", {}))), (5, 5, "assistant", "x" * 200_000), (5, 5, "assistant", "x" * 200_000), (5, 6, "assistant", '{"x": NaN}')]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert sum(r.n_calls for r in got) == 4 and sum(r.n_invalid for r in got) == 3 and sum(r.n_linked for r in got) == 0
    for r in got:
        assert tool_chat.canonical(json.loads(r.json)) == r.json
    assert run(spark, []) == []


def test_violations():
    s = {"type": "object", "properties": {"a": {"type": ["string", "null"], "maxLength": 2}, "b": {"type": "array", "items": {"type": "number", "maximum": 3}},
                                          "c": {"enum": [1, 2]}, "d": {"type": "boolean"}}, "required": ["a"], "additionalProperties": {"type": "integer"}}
    assert tool_chat.violations({"a": None, "b": [1, 2.5], "c": 2, "d": True, "e": 4.0}, s) == []
    bad = tool_chat.violations({"b": [1, "x", 9], "c": 3, "d": 1, "e": True}, s)
    assert bad == ["$.a: missing", "$.b[1]: not number", "$.b[2]: above maximum", "$.c: not one of the allowed values", "$.d: not boolean", "$.e: not integer"]
    assert tool_chat.violations({"a": "long"}, s) == ["$.a: too long"] and tool_chat.violations([], s) == ["$: not object"]


def plain(messages, schemas):
    """(conv, turn) -> every column, by going through each conversation; all (conv, turn) differ."""
    out, by = {}, {}
    for m in messages:
        by.setdefault(m[0], []).append((*m, tool_chat.read_message(m[2], m[3], schemas)))
    for conv, said in by.items():
        said.sort(key=lambda m: m[1])
        calls, results = {}, {}
        for m in said:
            for i, c in enumerate(m[4]["calls"]):
                calls.setdefault(c["id"], []).append((m[1], i, c))
            if m[4]["result_of"] is not None:
                results.setdefault(m[4]["result_of"], []).append(m[1])
        calls.pop(None, None)
        needs = {i: {n for _, _, c in cs for n in c["needs"] if n in calls} for i, cs in calls.items()}
        level = {}
        while True:
            new = {i: max([level[n] + 1 for n in ns], default=0) for i, ns in needs.items() if i not in level and all(n in level for n in ns)}
            if not new:
                break
            level |= new
        for m in said:
            r, mine = m[4], m[4]["calls"]
            has = [c["id"] is not None and len(results.get(c["id"], [])) > [x[:2] for x in calls[c["id"]]].index((m[1], i)) for i, c in enumerate(mine)]
            lev, status = None, "plain"
            text = {"content": r["content"], "role": m[2]}
            if mine:
                found = [level.get(c["id"]) for c in mine if c["id"] is not None]
                lev = max((x for x in found if x is not None), default=None)
                status = "cyclic" if None in found else "linked" if all(has) else "open"
                order = sorted(range(len(mine)), key=lambda i: (level.get(mine[i]["id"], 1 << 30), i))
                text["tool_calls"] = [{"arguments": json.loads(mine[i]["arguments"]), "id": mine[i]["id"], "name": mine[i]["name"]} for i in order]
            elif r["result_of"] is not None:
                nth = results[r["result_of"]].index(m[1])
                cs = calls.get(r["result_of"], [])
                call = cs[nth] if nth < len(cs) else None
                lev = level.get(r["result_of"]) if r["result_of"] in calls else None
                status = "orphan" if call is None else "early" if m[1] < call[0] else "linked"
                text |= {"tool_call_id": r["result_of"], "name": call[2]["name"] if call else None}
            out[conv, m[1]] = (m[2], lev, len(mine), sum(has), sum(bool(c["errors"]) for c in mine), status, tool_chat.canonical(text))
    return out


def test_query(spark):
    """The whole table against the plain version; every kind of trouble occurs in it."""
    sent = tool_chat.as_tool_transcript(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    want = plain([tuple(r) for r in sent.collect()], tool_chat.ANSWER_SCHEMA)
    got = {(r.conv_id, r.turn): (r.role, r.level, r.n_calls, r.n_linked, r.n_invalid, r.status, r.json)
           for r in queries.op7_tool_chats(spark, "/root/testdata/sf0.01").collect()}
    assert got == want
    assert {x[5] for x in want.values()} >= {"linked", "open", "cyclic", "early", "orphan"}
    assert sum(x[4] for x in want.values()) > 5 and max(x[1] or 0 for x in want.values()) >= 3


def test_no_text_ends_the_job(spark):
    deep = "[" * 2000 + "]" * 2000
    rows = [(1, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "f", "arguments": {"x": 1e999}}]}'),
            (1, 1, "assistant", '{"content": "\\ud800 \\ud83d\\ude00", "tool_calls": [{"id": "\\udfff", "name": "f", "arguments": {"\\ud900": "\\udc00"}}]}'),
            (1, 2, "assistant", '{"tool_calls": [{"id": "d", "name": "f", "arguments": {"x": %s}}]}' % deep),
            (1, 3, "assistant", '{"tool_calls": [{"id": "e", "name": "f", "arguments": {"x": %s}}]}' % ("[" * 50_000 + "]" * 50_000)),
            (1, 4, "tool", '{"tool_call_id": "d", "content": %s}' % deep), (1, 5, "tool", '{"tool_call_id": "d", "content": -1e400}'),
            (1, 6, "assistant", '{"tool_calls": [{"id": "g", "name": "f", "arguments": {"x": %s}}]}' % ("9" * 6000)),
            (1, 7, "assistant", '{"tool_calls": [{"id": "h", "name": "f", "arguments": "{\\"x\\": Infinity}"}]}')]
    got = run(spark, rows)
    assert [r.n_calls for r in got] == [0, 1, 1, 0, 0, 0, 0, 1] and len(got) == len(rows)
    assert [r.status for r in got][4] == "linked" and got[1].n_invalid == 1 and got[2].n_invalid == 1 and got[7].n_invalid == 1
    assert '"\ufffd \U0001f600"' in got[1].json and '"\ufffd":"\ufffd"' in got[1].json and deep in got[2].json
    assert json.loads(got[0].json)["content"] == rows[0][3]


def test_a_long_chain(spark, monkeypatch):
    """1,000 calls, each waiting for the one before, over several stretches; one cycle behind them."""
    rows = [(1, i, "assistant", calls((f"c{i}", "f", {"x": {"$result": f"c{i - 1}"}} if i else {"x": 0}))) for i in range(1000)]
    rows += [(1, 1000, "assistant", calls(("y", "f", {"x": {"$result": "z"}, "w": {"$result": "c999"}}))), (1, 1001, "assistant", calls(("z", "f", {"x": {"$result": "y"}})))]
    monkeypatch.setattr(tool_chat, "STRETCH", 400)
    got = {r.turn: (r.level, r.status) for r in run(spark, rows)}
    assert got == {i: (i, "open") for i in range(1000)} | {1000: (None, "cyclic"), 1001: (None, "cyclic")}
