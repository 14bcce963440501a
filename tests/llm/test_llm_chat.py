import itertools
import random

import numpy as np

from mailsift.llm.chat import (
    _STYLES, MARKED, SIZES, STATES, Model, cut_states, fit, format_chats, marker, observe, render, transcripts)
from mailsift.llm.common import crc_bucket, load

SF = "/root/testdata/sf0.001"


def test_markers():
    assert [marker(x)[0] for x in ("User: hi", "### Assistant", "[AI] yes", "Q: why", "- so", "plain text", "Dear: x", "")] == [2, 3, 3, 2, 4, 0, 0, 0]
    assert marker("Human: hello")[1] == "hello"


def test_viterbi_equals_enumeration():
    rnd = np.random.default_rng(4)
    model = Model.of_counts(rnd.random(sum(SIZES)) * 5)
    lines = ["User: a", "b. c.", "", "Answer: long " + "x" * 90]
    obs = observe(lines)

    def value(path):
        v = model.first[path[0]]
        for i, s in enumerate(path):
            v += sum(t[s, o] for t, o in zip(model.seen, obs[i])) + (model.step[path[i - 1], s] if i else 0)
        return v

    best = max(itertools.product(range(STATES), repeat=4), key=value)
    assert abs(value(model.viterbi(lines)) - value(best)) < 1e-9
    assert abs(model.reach(lines, True).max() - value(best)) < 1e-9


def test_segments_have_the_states_of_the_uncut_text(spark):
    rnd = random.Random(5)
    say = lambda: " ".join(rnd.choice(["yes", "no.", "why?", "a longer answer. With more."]) for _ in range(rnd.randint(1, 9)))
    rows = [(c, t, ("user", "assistant")[t % 2] if t else "system", say()) for c in range(30) for t in range(rnd.randint(2, 9))]
    rows += [(c, t, rnd.choice(["user", "assistant"]), say()) for c in (100, 101, None) for t in range(70)]
    convs = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    whole, parts = transcripts(convs, 10_000), transcripts(convs, 7)
    model = fit(whole)
    uncut = {r.conv_id: model.viterbi(r.text.split("\n")) for r in whole.collect()}
    cuts = {(r.conv_id, r.segment): (r.enter, r.leave) for r in cut_states(parts, model, ["conv_id"], "segment").collect()}
    states = {}
    for r in sorted(parts.collect(), key=lambda r: (str(r.conv_id), r.segment)):
        states.setdefault(r.conv_id, []).extend(model.viterbi(r.text.split("\n"), *cuts[r.conv_id, r.segment]))
    assert states == uncut
    got = {}
    for r in sorted(format_chats(parts, model, ["conv_id"], segment="segment").collect(), key=lambda r: (str(r.conv_id), r.segment)):
        got.setdefault(r.conv_id, []).extend(r.turns)
    for conv, turns in got.items():
        lines = [x for t in turns for x in t.text.split("\n") if x]
        want = [x for _, t in model.turns(next(r.text for r in whole.collect() if r.conv_id == conv)) for x in t.split("\n") if x]
        assert lines == want


def test_text_that_looks_like_a_marker_stays(spark):
    model = fit(transcripts(load(spark, SF, "conversations")))
    kept = lambda text: [t for _, t in model.turns(text)]
    assert kept("- bread\n- butter") == ["- bread\n- butter"]
    assert "".join(kept("User: hello there\n\n- bread\n- butter\n")).count("-") == 2
    assert Model.of_counts(np.zeros(sum(SIZES))).turns("Answer") == [("system", "Answer")]
    # a marker goes only with its own role's turn: never an assistant's "Note:"
    for text in ("Note: the meeting is at 5", "Q: what\n\nNote: the meeting is at 5"):
        lines = text.split("\n")
        for line, state in zip(lines, model.viterbi(lines)):
            assert state % 3 != MARKED or marker(line)[0] == 1 + state // 3


def test_a_held_out_marker_style(spark):
    """Learns from three styles of markers, reads the fourth."""
    texts = transcripts(load(spark, SF, "conversations"))
    own = lambda r: next((i for i, style in enumerate(_STYLES) if any(line.startswith(m.strip()) for line in r.text.split("\n") for m in style)), None)
    rows = texts.collect()
    for style in range(len(_STYLES)):
        known = spark.createDataFrame([r for r in rows if own(r) != style], texts.schema)
        model = fit(known)
        held = [r for r in rows if own(r) == style]
        right = sum(a // 3 == b // 3 for r in held for a, b in zip(model.viterbi(r.text.split("\n")), r.states))
        assert right >= 0.9 * sum(len(r.states) for r in held), style


def test_null_and_repeated_turns_are_numbered(spark):
    rows = [(1, None, "user", f"t{i}") for i in range(30)] + [(1, 5, "assistant", "same")] * 30
    parts = transcripts(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), 8).collect()
    assert len(parts) == 8 and all(r.text.count("\n\n") <= 8 for r in parts)


def test_held_out_roles(spark):
    texts = transcripts(load(spark, SF, "conversations"))
    model = fit(texts.filter(crc_bucket("conv_id", 2) != 0))
    want = {r.conv_id: r.roles for r in load(spark, SF, "conversations").selectExpr("conv_id", "struct(turn, role) as t").groupBy("conv_id")
            .agg({"t": "collect_list"}).selectExpr("conv_id", "transform(sort_array(`collect_list(t)`), x -> x.role) as roles").collect()}
    got = {r.conv_id: [t.role for t in r.turns] for r in format_chats(texts.filter(crc_bucket("conv_id", 2) == 0), model, ["conv_id"]).collect()}
    assert got and sum(want[k] == v for k, v in got.items()) >= 0.95 * len(got)


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (None, 0, "user", "x"), (2, None, None, "y\nz"), (3, 5, "robot", "w" * 50_000)]
    texts = transcripts(spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn int, role string, text string, states int"))
    out = format_chats(texts, fit(texts), ["conv_id"], segment="segment").collect()
    assert len(out) == 4 and all(r.chat == render([(t.role, t.text) for t in r.turns]) for r in out)
    empty = transcripts(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))
    assert format_chats(empty, fit(empty), ["conv_id"]).count() == 0
