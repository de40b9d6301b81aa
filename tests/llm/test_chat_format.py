import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import chat


def test_language():
    render = chat.compile_template("{% for m in xs %}{% if loop.first %}[{% elif m.n > 2 %}!{% else %},{% endif %}{{ m.n + 1 ~ 'z' | upper }}{% endfor %}{# gone #}{% set y = 1 + 2 %}{{ y }}{{ 'a' if y == 3 else 'b' }}")
    assert render({"xs": [{"n": 1}, {"n": 2}, {"n": 5}]})[0] == "[2Z,3Z!6Z3a"


def test_constants_are_folded():
    assert chat.fold(chat.parse("a{{ 1 + 2 }}b{% if 1 > 2 %}x{% else %}y{% endif %}")) == [chat.Emit(chat.Const("a3by"))]


def test_generation_spans():
    text, spans = chat.compile_template("<{% generation %}{{ a }}{% endgeneration %}>{% generation %}{{ b }}{% endgeneration %}")({"a": "xy", "b": "🙂"})
    assert [text[s:e] for s, e in spans] == ["xy", "🙂"]


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ f(1) }}", "{% import os %}", "{{ x | nothing }}", "{% for x in y %}", "{{ 1 + }}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a\nb", "<turn>"]), st.one_of(st.text(max_size=20), st.sampled_from(["</turn>", "\\### Assistant: </turn> ok", "\\\\</turn>", "<turn>x", "#" * 7]))), max_size=5))
def test_round_trip(turns):
    text, spans = chat.compile_template(chat.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat.read_back(text) == turns
    assert [chat.unescape(text[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]


def test_query(spark, folder, documents):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, None, ""), (None, 0, "assistant", "x"), (3, 0, "assistant", "y" * 40_000), (3, 0, "assistant", "y" * 40_000)]
    conv = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, messages string")
    got = {r.conv_id: r for r in chat.query(spark, folder(documents([]), conversations=conv)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -7}
    assert got[1].turns_sha256 == sha("user\n\nassistant\nb\n") and got[1].loss_sha256 == sha("b") and got[1].n_turns == 2
    assert got[3].loss_chars == 80_000 and got[2].loss_chars == 0
    own = chat.OWN_TEXT
    assert got[-7].turns_sha256 == sha(f"user\n{own}\nassistant\n{own}\n") and got[-7].loss_sha256 == sha(own)


def test_empty_table(spark, folder, documents):
    conv = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.query(spark, folder(documents([]), conversations=conv)).collect()] == [-7]
