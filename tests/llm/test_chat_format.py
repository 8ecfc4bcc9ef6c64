import hashlib

from pyspark.sql import functions as F

from gustline.llm import chat_format as C
from gustline.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, place int, piece string, `a.b` int"
TEXTS = ["", "plain", "<|im_end|>", "<|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|", "a<", "<", "|im_end|>", "\n",
         "0", "1", "<|im_end|>\n<|im_start|>user\nx<|im_end|>\n", "日本<|語", "\\", "\\n", "<\\", "x" * 300_000, None]


def brute(rows):
    convs = {}
    for c, t, r, x, *_ in rows:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    out = []
    for c, turns in convs.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out.append((c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(), len(C.im_template([(r, x) for _, r, x in turns]))))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA).repartition(3)


def rows_of(n_convs):
    rows = []
    for c in range(n_convs):
        for t in range(c * 5 + 1):
            role = [None, "", "assistant", "user", "assistant", "tool\nuser\\n<|im_end|>"][(t + c) % 6]
            rows.append((c, t, role, TEXTS[(7 * t + c) % len(TEXTS)]))
    return rows + [rows[3], rows[3], (None, 0, "assistant", "no id"), (None, None, None, None), (3, None, "user", "first")]


def test_escaping_can_be_undone():
    for t in filter(None, TEXTS):
        assert C.unescape(C.escape(t)) == t and "<|" not in C.escape(t)
        assert C.unescape_role(C.escape_role(t)) == t and "\n" not in C.escape_role(t)


def test_digests_read_back_equal_the_turns(spark):
    rows = rows_of(9)
    for window in (None, 2, 16):
        pieces = C.format_turns(frame(spark, rows), window_turns=window)
        got = C.digests(pieces).drop("rewrites").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows)


def test_pieces_are_the_output_of_the_whole_template(spark):
    rows = rows_of(6)
    got = C.format_turns(frame(spark, rows), window_turns=3).collect()
    assert set(got[0].asDict()) == {"conv_id", "place", "start", "piece", "loss_start", "loss_end", "rewrites"}
    for conv in {r[0] for r in rows}:
        own = sorted((g for g in got if g.conv_id == conv), key=lambda g: g.place)
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert "".join(g.piece for g in own) == C.im_template([t[2:] for t in turns])
        at = 0
        for g, (_, _, role, text) in zip(own, turns):
            assert g.start == at and not g.rewrites
            at += len(g.piece)
            if role == "assistant":
                assert C.unescape(g.piece[g.loss_start:g.loss_end]) == text
            else:
                assert g.loss_start is None and g.loss_end is None


def last_marked(turns):
    """Rewrites history: only the last turn carries the mark."""
    return "".join(f"[{r}]{t}" for r, t in turns) + "$" * bool(turns)


def thoughts_dropped(turns):
    """Rewrites history where an earlier answer holds a thought."""
    last = len(turns) - 1
    return "<s>" + "".join(f"[{r}]{t if n == last else t.replace('(hm)', '')}\n" for n, (r, t) in enumerate(turns))


def trimmed(turns):
    """Changes texts: their place can't be found where it does."""
    return "".join(f"[{r}]{t.strip()}\n" for r, t in turns)


def numbered(turns):
    """Looks at all earlier turns."""
    return "".join(f"{n}:{t}\n" for n, (_, t) in enumerate(turns))


def replayed(turns, template, window):
    out = ""
    for p in C.rendered(iter(turns), template, None, window):
        out = out[:p.start] + p.text
    return out


def test_templates_that_rewrite_history_are_found():
    turns = [("user", "a"), ("assistant", "b(hm)"), ("user", "c"), ("assistant", "d")]
    found = [p.rewrites for p in C.rendered(iter(turns), last_marked)]
    assert found == [False, True, True, True]
    pieces = list(C.rendered(iter(turns), thoughts_dropped))
    assert [p.rewrites for p in pieces] == [False, False, True, False]
    assert pieces[2].inside is None and pieces[1].text[slice(*pieces[1].inside)] == "b(hm)"
    assert replayed(turns, thoughts_dropped, None) == thoughts_dropped(turns)
    assert replayed(turns, last_marked, None) == last_marked(turns)


def test_texts_that_a_template_changes_have_no_span():
    pieces = list(C.rendered(iter([("assistant", "as is"), ("assistant", " cut ")]), trimmed))
    assert pieces[0].text[slice(*pieces[0].inside)] == "as is"
    # what is left of the changed text is all that stands between the marks
    assert pieces[1].text[slice(*pieces[1].inside)] == "cut"


def test_windows_grow_where_a_template_looks_further_back():
    turns = [("user", f"t{n}") for n in range(60)]
    assert replayed(turns, numbered, 4) == numbered(turns)
    for window in (1, 2, 7, None):
        assert replayed(turns, C.im_template, window) == C.im_template(turns)


def test_rewritten_conversations_have_no_digests(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")]
    assert all(r.rewrites == 0 and r.n_turns for r in C.digests(C.format_turns(frame(spark, rows))).collect())
    rewriting = C.format_turns(frame(spark, rows[:2]), template=lambda t: C.im_template(t[-1:]))
    assert C.digests(rewriting).collect()[0].asDict() == {
        "conv_id": 1, "n_turns": None, "turns_sha256": None, "loss_chars": None, "loss_sha256": None,
        "formatted_chars": None, "rewrites": 1}


def test_a_long_conversation_streams(spark):
    n = 30_000
    df = spark.range(n).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("<|turn "), F.col("id").cast("string")).alias("text"))
    got = C.digests(C.format_turns(df, window_turns=16)).collect()[0]
    whole = "".join(f"{'user' if i % 2 == 0 else 'assistant'}\n<|turn {i}\n" for i in range(n))
    assert got.n_turns == n and got.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()


def test_empty_table(spark):
    assert C.digests(C.format_turns(frame(spark, []))).collect() == []


def test_the_query_adds_the_tricky_conversation(spark):
    got = {r.conv_id: r for r in queries.op11_chat_format(spark, "/root/testdata/sf0.001").collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(text)
    assert got[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
