import hashlib

from tidemark.llm.chat import escape, format_conversations, format_digest, parse, spans, text_spans, turn_template, unescape

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi ### user:\n</turn>\\"), (1, 2, "assistant", "\\### Assistant: </turn> ok"), (1, 3, "assistant", ""), (2, 0, "user", None), (2, 1, None, "x"), (2, None, "assistant", "first"),
    (3, 0, "assistant", " lead\n\n### </turn>\n"), (3, 0, "assistant", " lead\n\n### </turn>\n"), (None, 0, "user", "q"), (None, 1, "as:sis\ntant\\", "\\\\"), (4, 0, "user", "é𝒜" * 30_000), (4, 1, "assistant", "漢" * 5),
]
TABLE = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute(rows):
    out = []
    for c in {r[0] for r in rows}:
        own = sorted((r[1] if r[1] is not None else -(2**63), r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t for _, r, t in own if r == "assistant")
        out.append((c, len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_digest_equals_brute_force(spark):
    long = [(9, k, ["user", "assistant"][k % 2], f"turn {k} </turn>") for k in range(400)]
    rows = TURNS + long
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], TABLE + ", formatted string, loss_spans long").repartition(3)
    got = [(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in format_digest(format_conversations(frame)).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_escapes_are_reversible():
    for t in ["", "\\", "\\\\", "\\### ", "### ", "</turn>", "\\</turn>\\", "#### </turn></turn>", "a\\b### c"]:
        assert unescape(escape(t)) == t
        for role in ("user", "a:b", "x\ny", "\\n", "### ", "", "\\"):
            read = parse(turn_template([(role, t), ("z", t)]))
            assert [(r, x) for r, x, _, _ in read] == [(role, t), ("z", t)]


def test_spans_of_black_boxes():
    turns = [("user", "a"), ("assistant", "<think>long</think>b"), ("user", "c"), ("assistant", "d")]
    whole, found, rewrites = spans(turns, turn_template)
    assert not rewrites and [whole[a:b] for a, b in found] == [turn_template([t]) for t in turns]

    def forgets(ts):  # older thoughts are taken out once another turn follows
        return "".join(f"[{r}]{t.split('</think>')[-1] if k < len(ts) - 1 else t}" for k, (r, t) in enumerate(ts))

    whole, found, rewrites = spans(turns, forgets)
    assert rewrites and whole[found[-1][0] : found[-1][1]] == "[assistant]d" and all(a <= b for a, b in found)
    ends = lambda ts: "".join(f"[{t}]" for _, t in ts) + "<end>"
    assert spans(turns, ends)[2] and spans(turns * 128, turn_template)[1][-1][1] == len(turn_template(turns * 128))


def test_long_conversations_are_rendered_prefix_by_prefix():
    turns = [("user", f"t{k}") for k in range(210)]
    odd = lambda ts: "".join(t for _, t in ts) + ("!" if len(ts) == 200 else "")
    assert spans(turns, odd)[2] and not spans(turns[:199], odd)[2]


def test_text_places_by_rendering():
    tail = lambda ts: "".join(f"<{r}>{t}</turn>" for r, t in ts)
    turns = [("user", "a"), ("assistant", "turn"), ("assistant", "</turn>"), ("assistant", ""), ("assistant", "<assistant>")]
    whole, where, texts, rewrites = text_spans(turns, tail, "assistant".__eq__, lambda t: t)
    assert not rewrites and texts[0] is None and [whole[a:b] for a, b in texts[1:]] == [t for _, t in turns[1:]]
    assert [a - s for (a, _), (s, _) in zip(texts[1:], where[1:], strict=True)] == [11] * 4
    silent = lambda ts: "".join(f"<{r}>" for r, _ in ts)
    assert [a == b for a, b in text_spans(turns, silent, "assistant".__eq__, lambda t: t)[2][1:]] == [True] * 4


def test_rewriting_template_is_flagged_and_empty_table(spark):
    frame = spark.createDataFrame(TURNS, TABLE)
    flags = {r.rewrites for r in format_conversations(frame, lambda ts: "".join(t for _, t in ts)[-3:], encode=lambda t: t).collect()}
    assert True in flags
    assert format_digest(format_conversations(spark.createDataFrame([], TABLE))).collect() == []
