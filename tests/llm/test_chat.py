import hashlib
import random

from pyspark.sql import functions as F

from freightlens.llm import chat


def fold_by_hand(events):
    """Events of one conversation in order, folded one at a time."""
    messages = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        m = e["message"]
        if e["kind"] == "regenerate":
            messages = {k: v for k, v in messages.items() if k < m}
            continue
        role, text = messages.get(m, (None, ""))
        text = (e["text"] or "") if e["kind"] == "edit" else text + (e["text"] or "")
        messages[m] = (e["role"] if m not in messages or role is None else role, text)
    return [(m, *messages[m]) for m in sorted(messages)]


def test_fold_equals_folding_one_event_at_a_time(spark):
    r = random.Random(3)
    events = []
    for conv in range(30):
        for seq in range(r.randrange(1, 40)):
            kind = r.choices(["delta", "edit", "regenerate"], [8, 1, 1])[0]
            message = r.randrange(4)
            events.append({"conv": conv, "message": message, "seq": seq, "kind": kind, "role": f"r{message}", "text": r.choice([None, "", f"{conv}.{seq} ", "x"])})
    frame = spark.createDataFrame(events, "conv int, message int, seq int, kind string, role string, text string").repartition(5)
    got = {}
    for row in chat.fold(frame, "conv", ["message"]).collect():
        got.setdefault(row["conv"], []).append((row["message"], row["role"], row["text"]))
    for conv in range(30):
        want = fold_by_hand([e for e in events if e["conv"] == conv])
        assert sorted(got.get(conv, [])) == want


TEXTS = ["plain", "", None, "\\", "\\\\", "</turn>", "<\\/turn>", "### ", "#\\## ", "####  ### x", "\\### Assistant: </turn> ok", "a\n</turn>\n### User: b", "é😀\\n", "\\</turn>\\", "line\r\nline", "</tur</turn>n>"]


def test_round_trip_of_hostile_texts_and_roles(spark):
    roles = ["user", "assistant", "system", "Assistant", "", None, "a: b", "=x", "</turn>\n", "tool:", "### "]
    rows = [(c, t, roles[(c + t) % len(roles)], TEXTS[(3 * c + t) % len(TEXTS)]) for c in range(20) for t in range(c % 7 + 1)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_log(chat.log_of(frame), "conversation", ["turn", "copy"])
    back = out.select("conversation", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                      chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("trained")).collect()
    assert len(back) == 20
    for row in back:
        want = [(r or "", t or "") for c, _, r, t in rows if c == row["conversation"]]
        assert [(t["role"], t["text"]) for t in row["turns"]] == want
        assert row["trained"] == "".join(t for r, t in want if r == "assistant")


def test_repeated_rows_and_ties(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, None, None), (1, None, "user", "n")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_log(chat.log_of(frame), "conversation", ["turn", "copy"])
    got = {r["conversation"]: [(t["role"], t["text"]) for t in r["t"]] for r in out.select("conversation", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert got == {1: [("user", "n"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("", "")]}
    empty = spark.createDataFrame([], frame.schema)
    assert chat.format_log(chat.log_of(empty), "conversation", ["turn", "copy"]).count() == 0


def test_log_of_turns_needs_folding(spark):
    """Every message is drafted, discarded, streamed anew and edited; folding alone gives the turns back."""
    rows = [(c, t, "user" if t % 2 else "assistant", TEXTS[(c + t) % len(TEXTS)]) for c in range(6) for t in range(c + 1)]
    log = chat.log_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    kinds = {}
    for r in log.collect():
        kinds.setdefault((r["conversation"], r["turn"]), []).append(r["kind"])
    assert len(kinds) == len(rows) and all({"delta", "edit", "regenerate"} == set(k) for k in kinds.values())
    got = [(r["conversation"], r["turn"], r["role"], r["text"]) for r in chat.fold(log, "conversation", ["turn", "copy"]).collect()]
    assert sorted(got) == sorted((c, t, role, text or "") for c, t, role, text in rows)
    assert chat.fold(log.where("kind <> 'edit'"), "conversation", ["turn", "copy"]).where("text LIKE '%wrong: %'").count() == len(rows)
    assert chat.fold(log.where("kind <> 'regenerate' AND kind <> 'edit'"), "conversation", ["turn", "copy"]).where("text LIKE 'draft: %'").count() == len(rows)


def test_tricky_conversation_of_the_query(spark, sf):
    from freightlens.llm.queries import QUERIES, TRICKY

    row = QUERIES["op2_chat_formatting"](spark, sf).where("conv_id = -7").first()
    lines = "".join(f"{role}\n{TRICKY[1]}\n" for role in ("user", "assistant"))
    assert row["n_turns"] == 2 and row["loss_chars"] == len(TRICKY[1])
    assert row["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(TRICKY[1].encode()).hexdigest()
