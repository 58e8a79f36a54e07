"""Rendered conversations against the turns themselves; templates that rewrite what they wrote."""

import hashlib
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ordersight.llm import chat, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows):
    """Digests per conversation from (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(x for _, _, r, x in own if r == "assistant")
        turns = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(),
                     len(chat.TaggedTemplate().render([(r, x) for _, _, r, x in own])))
    return out


def digests(rows):
    return {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"])
            for r in rows}


def test_query(spark):
    pd = pytest.importorskip("pandas")
    if not Path(FOLDER).exists():
        pytest.skip("no shared tables here")
    given_rows = pd.read_parquet(f"{FOLDER}/conversations.parquet")
    rows = [*given_rows[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None), *queries.PROBE]
    found = queries.op12_incremental_chat(spark, FOLDER).collect()
    assert digests(found) == slow(rows) and len(found) == len({r[0] for r in rows})
    probe = next(r for r in found if r["conv_id"] == -7)
    assert probe["n_turns"] == 2 and probe["loss_chars"] == len("</s>[INST] ok [/INST]")


ODD = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a]\n[/ROLE]"]), st.one_of(
    st.text(alphabet="<s>/[]INT\\ \n", max_size=20),
    st.lists(st.sampled_from(["</s>", "[INST]", "<<SYS>>", "\\", "<\\s>", "[/TEXT]", " ", ""]), max_size=6).map("".join))), max_size=6)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_round_trip_and_spans(turns):
    template = chat.TaggedTemplate()
    text, spans, rewritten = chat.located(template.render, turns)
    assert rewritten is None and text == template.render(turns) and template.parsed(text) == turns
    assert [(s[0], template.unescaped(text[s[3]:s[4]])) for s in spans] == turns
    assert [s[1] for s in spans] == [0, *[s[2] for s in spans]][:len(spans)]


def hides_earlier_thoughts(turns):
    """Only the last answer keeps what stands in <think>."""
    last = len(turns) - 1
    return "".join(f"<{r}>{x if i == last else x.split('</think>')[-1]}" for i, (r, x) in enumerate(turns))


def ends_once(turns):
    return "".join(f"<{r}>{x}" for r, x in turns) + "<end>"


def trims(turns):
    return "".join(f"<{r}>{x.strip()}" for r, x in turns)


def test_rewriting_is_found():
    turns = [("user", "a"), ("assistant", "<think>no</think>b"), ("user", "c"), ("assistant", "d")]
    text, spans, at = chat.located(hides_earlier_thoughts, turns)
    assert (text, spans, at) == (hides_earlier_thoughts(turns), [], 2)
    assert chat.located(ends_once, turns)[1:] == ([], 1)
    assert chat.located(trims, [("user", "a"), ("user", " b ")])[1:] == ([("user", 0, 7, 6, 7), ("user", 7, 14, 13, 14)], None)


class Plain(chat.TaggedTemplate):
    """A template whose turn depends on the role in front of it."""

    def render(self, turns):
        out, before = [], None
        for role, text in turns:
            out.append(f"|{role if role != before else '='}|{text}")
            before = role
        return "".join(out)


class Counting(chat.TaggedTemplate):
    def render(self, turns):
        return "".join(f"|{i}|{t}" for i, (_, t) in enumerate(turns))


class Rewriting(chat.TaggedTemplate):
    def render(self, turns):
        return ends_once(turns)


def test_long_conversations_in_segments(spark, monkeypatch):
    rows = [(1, 3 * t, "assistant" if t % 3 else "user", f"text {t} </s>") for t in range(150)] + [
        (2, 0, "user", None), (2, 0, "user", None), (2, None, None, "first"), (3, 5, "assistant", ""), (None, 1, "user", "x")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA + ", segment int, place string").repartition(4)
    numbered = {(r["conv_id"], r["place"]): r["text"] for r in chat.numbered(df, stretch=32).collect()}
    assert len(numbered) == len(rows) and [numbered[1, k] for k in range(150)] == [f"text {k} </s>" for k in range(150)]
    found = chat.formatted(df, segment=16)
    assert found.where("conv_id = 1").count() == 10
    assert digests(chat.read_back(found).collect()) == slow(rows)
    assert chat.formatted(df.limit(0)).count() == 0 and chat.read_back(found.limit(0)).count() == 0
    own = sorted(chat.formatted(df, Plain()).where("conv_id = 1").collect(), key=lambda r: r["segment"])
    want = Plain().render([(r[2], r[3]) for r in rows[:150]])
    assert "".join(r["text"] for r in own) == want
    for r in own:
        assert all(r["text"][s["text_start"]:s["text_end"]].startswith("text ") for s in r["spans"])


def test_a_template_that_looks_too_far_back_is_refused(spark):
    df = spark.createDataFrame([(1, t, "user", "x") for t in range(40)], SCHEMA)
    with pytest.raises(Exception, match="looks back by more"):
        chat.formatted(df, Counting()).collect()
    rows = chat.formatted(df, Rewriting()).collect()
    assert all(r["spans"] == [] and r["rewritten_at"] is not None for r in rows) and min(r["rewritten_at"] for r in rows) == 1
