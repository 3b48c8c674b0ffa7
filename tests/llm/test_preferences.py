from __future__ import annotations

from textloom.llm.preferences import END, answered_by_next, conversations, op7_preferences, preferences

from .helpers import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(chosen, rejected):
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1
    show = lambda turns: "".join(f"<|{r}|>\n{t}{END}" for r, t in turns)

    def mask(turns):
        at, out = 0, []
        for r, t in turns:
            begin = at + len(f"<|{r}|>\n")
            at = begin + len(t) + len(END)
            if r == "assistant":
                out.append(f"{begin}:{at}")
        return ",".join(out)

    return n, show(chosen[:n]), show(chosen[n:]), show(rejected[n:]), mask(chosen[n:]), mask(rejected[n:])


def by_conv(rows):
    out = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def check(found, rows):
    convs = by_conv(rows)
    ids = sorted(convs)
    assert sorted(r.conv_id for r in found) == ids
    for r in found:
        nxt = ids[(ids.index(r.conv_id) + 1) % len(ids)]
        last = lambda c: max((i for i, (role, _) in enumerate(convs[c]) if role == "assistant"), default=None)
        other = list(convs[r.conv_id])
        if last(r.conv_id) is not None and last(nxt) is not None:
            other[last(r.conv_id)] = ("assistant", convs[nxt][last(nxt)][1])
        assert (r.n_prompt_turns, r.prompt, r.chosen, r.rejected, r.chosen_mask, r.rejected_mask) == brute(convs[r.conv_id], other)
        assert r.next_id == nxt and r.same == (other == convs[r.conv_id])


def test_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(op7_preferences(spark, SF).collect(), rows)


def test_odd_rows(spark):
    rows = [(1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 2, "assistant", "hello"), (2, 1, "user", "hi"), (3, None, None, None), (3, 1, "assistant", ""), (None, 1, "user", "lost"), (4, 1, "assistant", "\U0001f600 long " * 5000), (5, 1, "assistant", "hello"), (5, 1, "user", "tie")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS turns", "'x' AS next_id", "'x' AS chosen")
    check(preferences(answered_by_next(conversations(df))).collect(), rows)
    assert preferences(answered_by_next(conversations(spark.createDataFrame([], SCHEMA)))).count() == 0
    one = preferences(answered_by_next(conversations(spark.createDataFrame([(1, 1, "assistant", "a")], SCHEMA)))).collect()
    assert [(r.next_id, r.same, r.chosen) for r in one] == [(1, True, "")]


def test_masks_point_at_what_the_assistant_says(spark):
    for r in op7_preferences(spark, SF).collect():
        for text, mask in ((r.chosen, r.chosen_mask), (r.rejected, r.rejected_mask)):
            for span in filter(None, mask.split(",")):
                a, b = map(int, span.split(":"))
                assert text[:a].endswith("<|assistant|>\n") and text[a:b].endswith(END)
