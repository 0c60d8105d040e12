"""Cases in which an operator once left out part of its job."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

from auditloom.llm import chat, spans
from auditloom.llm.queries_chat import SCHEMAS


def text(*lengths: int, tag: str) -> str:
    """Sentences of so many words that are found nowhere else."""
    return " ".join(" ".join(f"{tag}{i}w{k}" for k in range(n)) + "." for i, n in enumerate(lengths))


def covered(rows: list[tuple[int, str]], several=3, words=15, long=40) -> dict[int, int]:
    """Sentences of each row in any repeat of any run that is long enough, whatever shorter runs there are."""
    seen: dict[tuple, list] = defaultdict(list)
    for key, t in rows:
        s = [tuple(t[a:b].split()) for a, b in spans.sentences(t)]
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                n = sum(map(len, s[i:j]))
                if (j - i >= several and n >= words) or n >= long:
                    seen[tuple(s[i:j])].append((key, i, j))
    gone: dict[int, set] = {key: set() for key, _ in rows}
    for places in seen.values():
        for key, i, j in sorted(places)[1:]:
            gone[key] |= set(range(i, j))
    return {key: len(g) for key, g in gone.items()}


def test_spans_up_to_their_ends(spark):
    rows = [(0, text(45, 10, 8, tag="a")), (1, text(45, 10, 8, tag="a") + " " + text(30, 30, tag="b")), (2, text(41, 39, tag="c")), (3, text(9, tag="d") + " " + text(41, 39, tag="c") + " " + text(50, tag="e"))]
    rng = random.Random(5)
    for k in range(4, 60):
        pool = [text(*(rng.choice((2, 4, 6, 9, 25, 42)) for _ in range(rng.randint(1, 9))), tag=f"p{p}") for p in (0, 1)]
        start = rng.randint(0, 3)
        parts = [f"s{rng.randint(0, 7)} " * rng.choice((3, 5, 8, 20, 41)) + "x." for _ in range(rng.randint(0, 12))]
        rows.append((k, " ".join([text(7, 7, tag=f"u{k}"), " ".join(pool[k % 2].split(". ")[start:]) + ".", *parts])))
    got = {r["doc_id"]: r["n_removed"] for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string"), ends=True).collect()}
    assert got[1] == 3 and got[3] == 2
    assert got == covered(rows)


def test_chat_keeps_every_call_and_result(spark):
    say = lambda t: json.dumps({"text": t, "turn": 1})
    rows = [("c", 1, "user", None, "a", "reply", say(f"question number {i} of the call"), None) for i in (0, 1, 1, 2)]
    rows += [("c", 2, "assistant", t, "a", None, None, None) for t in ("p", "p", "q", "r", "r")]
    rows += [("c", 4, "assistant", t, "gone", None, None, None) for t in ("x", "x", "y", None)]
    rows += [("c", 9, "user", None, "a", "reply", say("question number 0 of the call"), "z")]
    # nothing else tells these calls and these results apart
    rows += [("d", 1, role, t, "a", "reply", say("a question that is long enough"), after) for role, t, after in (("user", "s", None), ("user", "t", None), ("tool", "s", None), ("user", "s", "z"))]
    rows += [("d", 2, "assistant", "p", "a", None, more, after) for more, after in ((None, None), ("{}", None), (None, "z"))]
    df = spark.createDataFrame(rows, "conv string, seq long, role string, content string, call_id string, name string, arguments string, after string")
    got = chat.link(df, SCHEMAS).collect()
    facts = Counter()
    for r in got:
        said = json.loads(r["canonical"])
        facts[r["conv"], r["kind"], r["seq"], (said["arguments"] or {}).get("text", "")[:17], said["result"], r["n_repeats"]] += 1
    q = "question number "
    assert facts == Counter({
        ("c", "linked", 1, q + "0", "p", 1): 1, ("c", "repeated_call", 1, q + "1", None, 2): 1, ("c", "repeated_call", 1, q + "2", None, 1): 1, ("c", "repeated_call", 9, q + "0", None, 1): 1,
        ("c", "repeated_result", 2, "", "p", 1): 1, ("c", "repeated_result", 2, "", "q", 1): 1, ("c", "repeated_result", 2, "", "r", 2): 1,
        ("c", "orphan_result", 4, "", None, 1): 1, ("c", "repeated_result", 4, "", "x", 2): 1, ("c", "repeated_result", 4, "", "y", 1): 1,
        ("d", "linked", 1, "a question that i", "p", 1): 1, ("d", "repeated_call", 1, "a question that i", None, 1): 3, ("d", "repeated_result", 2, "", "p", 1): 2,
    })
    # a linked row holds a call and a result, any other row that is no message holds one
    assert sum(r["n_repeats"] + (r["kind"] == "linked") for r in got) == len(rows)
    assert all(r["position"] is None and "repeated" in r["issues"] for r in got if r["kind"].startswith("repeated"))


def test_chat_orders_calls_that_wait_for_several(spark):
    waits = {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["b", "gone"], "e": ["c", "d"], "x": ["y", "a"], "y": ["x"], "z": ["y", "e"]}
    rows = [("c", 9 - i, "user", None, k, "reply", None, v) for i, (k, v) in enumerate(waits.items())] + [("c", 5, "system", "s", None, None, None, None), (None, 1, "user", "t", "a", "reply", None, ["b"])]
    df = spark.createDataFrame(rows, "conv string, seq long, role string, content string, call_id string, name string, arguments string, after array<string>")
    got = chat.in_order(chat.link(df, SCHEMAS)).collect()
    at = {r["call_id"]: r["position"] for r in got if r["call_id"]}
    assert at == {"a": 0, "b": 1, "c": 2, "d": 2, "e": 3, "x": None, "y": None, "z": None}
    order = [r["call_id"] for r in got if r["position"] is not None]
    assert all(order.index(w) < order.index(k) for k in order for w in waits[k] if w in order)
    assert all("cycle" in r["issues"] for r in got if r["call_id"] in ("x", "y", "z"))
