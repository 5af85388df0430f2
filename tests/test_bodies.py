"""Bodies rewritten in place, against a walk over the parsed JSON in plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.operators import bodies as BD
from veilframe.operators import pii
from veilframe.operators import prompt as P
from veilframe.operators.recognizers import Recognizer

MAIL = re.compile(r"[a-z]+@[a-z]+\.org")
MAIL_ONLY = (Recognizer("MAIL", r"[a-z]+@[a-z]+\.org", 0.9, anchor="@"),)


def dumps(x):
    return json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


class Walk:
    """Scrubs e-mail addresses of one body, numbering them over the whole request."""

    def __init__(self, provider, body):
        self.mapping, self.body, self.provider = {}, json.loads(json.dumps(body)), provider
        getattr(self, provider)(self.body)

    def text(self, s):
        def name(m):
            key = f"<MAIL_{len(self.mapping) + 1}>"
            self.mapping[key] = m[0]
            return key
        return MAIL.sub(name, s)

    def content(self, holder, key, tools=False):
        c = holder.get(key)
        if isinstance(c, str):
            holder[key] = self.text(c)
        for part in c if isinstance(c, list) else []:
            if isinstance(part, dict) and part.get("type") == "text":
                part["text"] = self.text(part.get("text", ""))
            elif tools and isinstance(part, dict) and part.get("type") == "tool_result" and isinstance(part.get("content"), str):
                part["content"] = self.text(part["content"])

    def openai(self, body):
        body["messages"] = body.get("messages") or []
        for m in body["messages"]:
            self.content(m, "content")

    def anthropic(self, body):
        self.content(body, "system")
        for m in body.get("messages") or []:
            self.content(m, "content", tools=True)

    def gemini(self, body):
        system = body.get("systemInstruction")
        for holder in [*(body.get("contents") or []), *([system] if isinstance(system, dict) else [])]:
            for part in holder.get("parts") or []:
                if isinstance(part, dict) and isinstance(part.get("text"), str):
                    part["text"] = self.text(part["text"])


def said(x):
    return x if isinstance(x, str) else "None" if x is None else str(x) if isinstance(x, bool) else dumps(x)


def cache_text(provider, body):
    out = []
    if provider == "anthropic" and body.get("system"):
        out.append(f"system: {said(body['system'])}")
    for m in body.get("messages") or [] if provider != "gemini" else []:
        role, c = said(m.get("role", "")), m.get("content", "")
        if isinstance(c, list):
            out += [f"{role}: " + (said(p.get("text", "")) if isinstance(p, dict) and p.get("type") == "text" else dumps(p)) for p in c]
        else:
            out.append(f"{role}: {said(c)}")
    if provider == "gemini":
        for c in body.get("contents") or []:
            out += [f"{said(c.get('role', ''))}: " + (said(p["text"]) if isinstance(p, dict) and "text" in p else dumps(p)) for p in c.get("parts") or []]
        if body.get("systemInstruction"):
            out.append("system: " + dumps(body["systemInstruction"]))
    elif body.get("tools"):
        out.append("tools:" + dumps(body["tools"]))
    return "\n".join(out)


SHAPES = [
    ("openai", {}), ("openai", {"messages": None, "model": "m"}), ("openai", {"messages": []}),
    ("openai", {"messages": [{"role": "assistant", "content": None}, {"role": "user"}, {"content": "no role a@b.org"}, {"role": None, "content": True}]}),
    ("openai", {"messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "x@y.org"}}]}]}),
    ("openai", {"messages": [{"role": "user", "content": [{"text": "untyped a@b.org"}, "bare a@b.org", 7, None, {"type": "text"}, {"type": "text", "text": "é \" a@b.org\n"}]}],
                "tools": [{"n": 1.5, "b": None}], "zz": {"é": [True, {}]}}),
    ("anthropic", {"system": "", "messages": [{"role": "user", "content": "a@b.org"}]}),
    ("anthropic", {"system": "be kind to a@b.org", "messages": []}), ("anthropic", {"system": None}),
    ("anthropic", {"system": [{"type": "text", "text": "c@d.org"}, {"type": "tool_result", "content": "e@f.org"}],
                   "messages": [{"role": "system", "content": [{"type": "tool_result", "content": "g@h.org a@b.org"}, {"type": "tool_result", "content": [1]}]}], "tools": []}),
    ("gemini", {"systemInstruction": "a@b.org", "contents": [{"role": "user", "parts": [{"text": "i@j.org"}, {"text": 5}, {"inline": "k@l.org"}]}]}),
    ("gemini", {"systemInstruction": {"parts": [{"text": "m@n.org"}]}, "contents": [{"parts": None}, {"role": "model"}, {"role": "user", "parts": [{"text": "o@p.org o@p.org"}]}]}),
    ("gemini", {"contents": None}),
]


def random_bodies(n):
    rnd = random.Random(12)
    words = ["plain", "a@b.org", "long c@d.org mid e@f.org", "", "é ü 日本", "<MAIL_1>"]
    text = lambda: " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))
    part = lambda: rnd.choice([{"type": "text", "text": text()}, {"type": "tool_result", "content": text()}, {"text": text()}, {"type": "image", "d": text()}])
    content = lambda: rnd.choice([text(), [part() for _ in range(rnd.randint(0, 3))], None])
    out = []
    for _ in range(n):
        provider = rnd.choice(P.PROVIDERS)
        body = {"model": "m", "temperature": rnd.choice([0, 0.5, None])}
        if provider == "gemini":
            body["contents"] = [{"role": "user", "parts": [part() for _ in range(rnd.randint(0, 3))]} for _ in range(rnd.randint(0, 4))]
            if rnd.random() < 0.5:
                body["systemInstruction"] = {"parts": [{"text": text()}]}
        else:
            body["messages"] = [{"role": rnd.choice(["user", "assistant"]), "content": content()} for _ in range(rnd.randint(0, 4))]
            if provider == "anthropic" and rnd.random() < 0.5:
                body["system"] = content()
        out.append((provider, body))
    return out


@pytest.fixture(scope="module")
def cases():
    return SHAPES + random_bodies(150)


@pytest.fixture(scope="module")
def requests(spark, cases):
    rows = [(i, p, json.dumps(b)) for i, (p, b) in enumerate(cases)]
    return spark.createDataFrame(rows, "id long, provider string, b string").withColumn("v", F.parse_json("b")).drop("b")


def test_scrubbed_bodies_match_a_walk(requests, cases):
    got = {r["id"]: r for r in BD.scrub_bodies(requests, recognizers=MAIL_ONLY).collect()}
    assert len(got) == len(cases)  # also requests without any text
    for i, (provider, body) in enumerate(cases):
        want = Walk(provider, body)
        # a walk numbers Gemini's and Anthropic's fields in the same order as ours
        assert got[i]["body"] == dumps(want.body), (provider, body)
        assert got[i]["mapping"] == want.mapping and len(got[i]["spans"]) == len(want.mapping)


def test_one_way_bodies_hold_no_mapping(requests):
    rows = BD.scrub_bodies(requests, mode="one_way", recognizers=MAIL_ONLY).collect()
    assert all(r["mapping"] == {} for r in rows)
    assert all(not MAIL.search(p["text"]) for r in rows for p in r["parts"] if p["kind"] != "other")


def test_prompt_text_matches_a_walk(requests, cases):
    got = dict(requests.select("id", P.prompt_text(F.col("v"), F.col("provider"))).collect())
    for i, (provider, body) in enumerate(cases):
        assert got[i] == cache_text(provider, body), (provider, body)


def test_exploded_parts_scrub_like_whole_bodies(requests):
    whole = BD.scrub_bodies(requests, recognizers=MAIL_ONLY)
    parts = P.scrub_requests(P.explode_prompt_parts(requests, "id"), "id", recognizers=MAIL_ONLY)
    a = {r["id"]: r["mapping"] for r in whole.collect() if r["mapping"]}
    b = {r["id"]: r["mapping"] for r in parts.collect() if r["mapping"]}
    assert a and a == b


RESPONSES = [
    ("openai", {"choices": [{"message": {"role": "assistant", "content": "to <MAIL_1>"}}, {"delta": {"content": "<MAIL_1>,<MAIL_9>"}},
                            {"message": {"content": [1]}, "delta": {"role": "x"}}], "id": "<MAIL_1>"}),
    ("openai", {"choices": None}), ("openai", {}),
    ("anthropic", {"content": [{"type": "text", "text": "<MAIL_1>"}, {"type": "tool_use", "text": "<MAIL_1>"}, {"type": "text"}]}),
    ("gemini", {"candidates": [{"content": {"parts": [{"text": "<MAIL_1> \"q\""}, {"x": "<MAIL_1>"}]}}, {"content": None}, {}]}),
]


def restored(provider, body, mapping):
    body = json.loads(json.dumps(body))
    back = lambda s: re.sub(r"<MAIL_\d+>", lambda m: mapping.get(m[0], m[0]), s)
    if not mapping:
        return body
    for c in body.get("choices") or []:
        m = c.get("message") or {}
        if isinstance(m.get("content"), str):
            m["content"] = back(m["content"])
        c["message"] = m
        if isinstance((c.get("delta") or {}).get("content"), str):
            c["delta"]["content"] = back(c["delta"]["content"])
    for b in body.get("content") or []:
        if b.get("type") == "text":
            b["text"] = back(b.get("text", ""))
    for c in body.get("candidates") or []:
        for p in (c.get("content") or {}).get("parts") or []:
            if isinstance(p.get("text"), str):
                p["text"] = back(p["text"])
    return body


@pytest.mark.parametrize("mapping", [{"<MAIL_1>": "a@b.org \\ \"x\""}, {}, None])
def test_restored_bodies(spark, mapping):
    rows = [(i, p, json.dumps(b)) for i, (p, b) in enumerate(RESPONSES)]
    resp = spark.createDataFrame(rows, "id long, provider string, b string").withColumn("v", F.parse_json("b"))
    maps = spark.createDataFrame([(i, mapping) for i in range(len(RESPONSES)) if mapping is not None], "id long, mapping map<string,string>")
    got = {r["id"]: r["restored"] for r in BD.restore_bodies(resp, maps, "id").collect()}
    assert got == {i: dumps(restored(p, b, mapping)) for i, (p, b) in enumerate(RESPONSES)}


# --- spans ------------------------------------------------------------------
def test_filters_reach_the_scan_through_scrub(spark, tmp_path):
    spark.createDataFrame([(1, "a@b.org", "en"), (5, "c@d.org", "de")], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "d"))
    df = pii.scrub(spark.read.parquet(str(tmp_path / "d"))).where("doc_id = 5").select("doc_id", "scrubbed_text")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,5)" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    assert [tuple(r) for r in df.collect()] == [(5, "<EMAIL_ADDRESS_1>")]


def brute_resolve(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[0], s[2])):
        if all(s[1] <= k[0] or s[0] >= k[1] for k in kept):
            kept.append(s)
    return sorted(kept)


def test_sweep_equals_greedy_over_all_pairs(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        n = rnd.choice([0, 1, 2, 5, 40, 700])
        spans = set()
        while len(spans) < n:
            s = rnd.randrange(0, n * rnd.choice([2, 6]))
            spans.add((s, s + rnd.randint(1, 9), rnd.choice("ABC"), rnd.choice([0.5, 0.6, 0.9]), "v", s))
        rows.append((i, sorted(spans)))
    df = spark.createDataFrame(rows, f"id long, spans {pii.SPAN_ARRAY}")
    got = {r["id"]: [tuple(s) for s in r["s"]] for r in df.select("id", pii.resolve_overlaps(F.col("spans")).alias("s")).collect()}
    assert got == {i: brute_resolve(s) for i, s in rows}


@pytest.mark.parametrize("mode", pii.SCRUB_MODES)
def test_many_spans_number_and_rebuild(spark, mode):
    rnd = random.Random(1)
    values = [f"{a}@{b}.org" for a in ("ann", "bob", "eve") for b in ("x", "y")]
    text = " é日 ".join(rnd.choice(values) if rnd.random() < 0.7 else "https://h.example/" + "p" * rnd.randint(1, 4) for _ in range(3000)) + " end ü"
    r = pii.scrub(spark.createDataFrame([(1, text)], "id long, text string"), "text", mode).collect()[0]
    seen, counts = {}, {}

    def name(m):
        kind = "EMAIL_ADDRESS" if "@" in m[0] else "URL"
        if mode == "one_way" and (kind, m[0]) in seen:
            return seen[kind, m[0]]
        counts[kind] = counts.get(kind, 0) + 1
        seen[kind, m[0]] = f"<{kind}_{counts[kind]}>"
        return seen[kind, m[0]]

    assert r["scrubbed_text"] == re.sub(r"[a-z]+@[a-z]+\.org|https://h\.example/p+", name, text)
    if mode == "reversible":
        back = spark.createDataFrame([(r["scrubbed_text"], r["mapping"])], "t string, m map<string,string>")
        assert back.select(pii.restore(F.col("t"), F.col("m"))).collect()[0][0] == text


def test_work_grows_with_the_spans(spark):
    """Twice the addresses in one text take at most 2.2 times as long (plus what a small query takes)."""
    import time

    def seconds(n):
        text = " ".join(f"mail user{i}@example{i % 7}.com é" for i in range(n))
        df = pii.scrub(spark.createDataFrame([(1, text)], "id long, text string")).select("scrubbed_text", "mapping")
        df.collect()
        best = []
        for _ in range(3):
            t = time.perf_counter()
            df.collect()
            best.append(time.perf_counter() - t)
        return min(best)

    base, half, whole = seconds(1), seconds(8_000), seconds(16_000)
    assert whole - base <= 2.2 * (half - base) + 0.3
