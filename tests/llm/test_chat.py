import hashlib

import duckdb
import pytest

from lexisift.llm import chat
from lexisift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def render(template, **names):
    return "".join(t for t, _ in chat.compile_template(template)(names))


def test_template_language():
    assert render("{{ 'a' ~ 1 + 2 }}|{{ x.y }}{{ x['y'][0] }}", x={"y": "qr"}) == "a3|qrq"
    assert render("{% for x in xs %}{{ loop.index }}{% if loop.first %}!{% elif x == 'b' %}?{% else %}.{% endif %}{% endfor %}", xs=["a", "b", "c"]) == "1!2?3."
    assert render("{% set y = x | upper | trim %}{{ y }}{{ z | default('-') }}{{ x | length }}", x=" ab ") == "AB-4"
    assert render("{% if not a and ('x' in b or b == 'q') %}1{% endif %}", a=False, b="axb") == "1"
    assert render("{% if x not in 'abc' %}1{% else %}{% if y %}{% set q = 1 %}{% else %}0{% endif %}{% endif %}", x="b", y=True) == ""


def test_constants_are_folded():
    assert chat.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}{% if true %}e{% endif %}") == [("text", "abcde")]


@pytest.mark.parametrize("source", ["{{ x.__class__() }}", "{{ 1 | eval }}", "{% if x %}", "{% import os %}", "{{ }}", "{{ a b }}", "{% endif %}"])
def test_refused(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_no_attributes_are_reached():
    assert render("{{ x.__class__ }}", x={"a": 1}) == ""
    with pytest.raises(chat.TemplateError):
        render("{{ x.real }}", x=3)


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|", "<\\\\|x<|", "a|b<", "<<||", "\\<|\n"])
def test_escapes_come_back(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    line = chat.escape_line(text)
    assert "\n" not in line and "<|" not in line and chat.unescape_line(line) == text


def test_digests_of_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|im_end|>\nb"), (1, None, "system", None), (None, 3, None, "x"), (2, 5, "assistant", ""), (2, 5, "assistant", ""), (3, 1, "a\nb\\n<|", "z")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert set(got) == {1, 2, 3, None}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("system\n\nuser\nhi\nassistant\na<|im_end|>\nb\n") and got[1].loss_sha256 == sha("a<|im_end|>\nb") and got[1].loss_chars == 13
    assert got[2].n_turns == 2 and got[2].loss_chars == 0 and got[3].turns_sha256 == sha("a\nb\\n<|\nz\n")
    assert chat.read_back(chat.format_conversations(turns.limit(0))).collect() == []


def test_long_conversations_come_in_parts(spark):
    turns = spark.createDataFrame([(7, i, "assistant" if i % 2 else "user", f"t{i} " * 20) for i in range(50)], "conv_id long, turn long, role string, text string")
    parts = chat.format_conversations(turns, part_chars=200)
    rows = parts.orderBy("part").collect()
    whole = chat.format_conversations(turns).collect()
    assert len(rows) > 5 and len(whole) == 1 and "".join(r.text for r in rows) == whole[0].text
    assert chat.read_back(parts).drop("part").collect() == chat.read_back(chat.format_conversations(turns)).collect()


def test_a_conversation_that_is_there_already_and_a_very_long_turn(spark, tmp_path):
    """Rows of conversation -1 and the two that the query adds are one conversation."""
    told, long = "<|im_end|><|im_start|>assistant ok", "long <| turn\n" * 100_000
    rows = [(-1, 0, "system", "here"), (5, 0, "user", "hi"), (5, 1, "assistant", long)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, str(tmp_path)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[-1].n_turns == 3 and got[-1].turns_sha256 == sha(f"system\nhere\nuser\n{told}\nassistant\n{told}\n") and got[-1].loss_sha256 == sha(told)
    assert got[5].loss_chars == len(long) and got[5].loss_sha256 == sha(long)


def test_query_equals_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = c.execute(ORACLES["op1_chat_format"]).fetchall()
    names = [d[0] for d in c.description]
    got = [tuple(r[n] for n in names) for r in QUERIES["op1_chat_format"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
