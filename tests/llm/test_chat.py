"""The template compiler, and conversations formatted and read back, against plain Python."""

import hashlib
import random

import pytest

from sayframe.llm import chat

MESSAGES = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "<s>Yo"}]


def shown(source, messages=MESSAGES, **constants):
    pieces = list(chat.compile_template(source, constants, ("<s>",))(iter(messages)))
    return "".join({chat.OPEN: "«", chat.CLOSE: "»"}.get(p, p) for p in pieces)


@pytest.mark.parametrize(
    "source, expected",
    [
        ("a{# remark #}b", "ab"), ("{{ 'x' ~ 1 + 2 }}", "x12"), ("{{ 1 + 2 }}{{ none }}{{ true }}", "3True"), ("a  {%- if 1 == 2 -%}  b{% elif x in 'xyz' %} c {%- else %}d{% endif %}", "a c"),
        ("{% for m in messages %}{{ loop.index0 }}{{ m.role }}:{{ m['text'] | trim | upper }}{{ ';' if not loop.last else '.' }}{% endfor %}", "0user:HI;1assistant:<S>YO."),
        ("{% for m in messages %}{% if m.role == 'assistant' and x %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% endif %}{% endfor %}", "«<\\s>Yo»"),
        ("{% set x = 'new' %}{{ x }}", "new"), ("{{ m.a.b }}", ""), ("{{ 'a' not in 'b' or m }}{{ 'it\\'s\\n' }}", "Trueit's\n"), ("", ""),
    ],
)
def test_templates(source, expected):
    assert shown(source, x="x", m={"a": 1}) == expected


@pytest.mark.parametrize("source", ["{% if x %}", "{{ x", "{{ y }}", "{{ x | safe }}", "{{ x() }}", "{{ 1 + }}", "{% endfor %}", "{% for x %}{% endfor %}", "{{ x %}", "{% set 1 = 2 %}", "{% for a in messages %}{% for b in messages %}{% endfor %}{% endfor %}", "{{ messages }}", "{% if x %}{% else %}{% else %}{% endif %}", "{{ }}"])
def test_errors(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source, {"x": 1})


def test_folding():
    tree = chat.fold(chat.parse("a{{ x ~ 'b' }}{% if x == 'q' %}c{% elif m %}d{% elif x %}e{% else %}{{ m }}{% endif %}"), {"x": "X"}, chat.Controls(()))
    assert [(n.kind, n.value) for n in tree] == [("text", "aXb"), ("if", None)]
    assert len(tree[1].args) == 1 and [b[0].value for b in tree[1].bodies] == ["d", "e"]
    assert [n.value for n in chat.fold(chat.parse(chat.TEMPLATE), chat.CONSTANTS, chat.Controls(chat.CONTROLS))][:1] == ["<s>"]


def test_nothing_of_python_is_reached():
    assert shown("{{ x.__class__ }}{{ x['upper'] }}{{ loop }}|{% for m in messages %}{{ m.__len__ }}{% endfor %}", x="abc") == "|"


def test_escapes():
    controls, r = chat.Controls(chat.CONTROLS), random.Random(2)
    for _ in range(3000):
        text = "".join(r.choice(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "s>", "/", "INST]", "a"]) for _ in range(r.randint(0, 9)))
        safe = controls.escape(text)
        assert controls.unescape(safe) == text and not controls.any_of.search(safe)
    with pytest.raises(ValueError):
        chat.Controls(["aba"])


@pytest.mark.parametrize("limit", [1, 40, 1 << 20])
def test_query_is_plain_python(spark, tmp_path, limit, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", limit)
    monkeypatch.setattr(chat.format_conversations, "__defaults__", (*chat.format_conversations.__defaults__[:-1], limit))
    r = random.Random(1)
    bits = ["</s>", "[INST]", "[/INST]", "<s>", "\\", "é😀", "\n", " ok ", "[", "<", "assistant"]
    rows = [(c, r.choice([None, 1, 1, 2, 3]), r.choice([None, "user", "assistant", "[INST]", "a\nb"]), r.choice([None, "", "".join(r.choices(bits, k=r.randint(0, 12)))])) for c in [None, 0, 1, 2, 2**40] for _ in range(r.randint(1, 9))]
    rows += [rows[3], rows[3], (9, 0, "assistant", "long " * 5000)]
    spark.createDataFrame([(*x, 1, "k") for x in rows], "conv_id long, turn int, role string, text string, part int, key string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    odd = "</s>[INST] ok [/INST]"
    everything = {}
    for c, turn, role, text in [*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)]:
        everything.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    expected, escape = {}, chat.Controls(chat.CONTROLS).escape
    for c, own in everything.items():
        turns = [(role.decode(), text.decode()) for _, _, role, text in sorted(own)]
        loss = "".join(t for role, t in turns if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        whole = "<s>" + "".join(f"[INST]{escape(a)}[/INST]{escape(b)}</s>" for a, b in turns)
        expected[c] = (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), digest(loss), len(whole))
    assert {row[0]: tuple(row)[1:] for row in chat.op12_chat_formatting(spark, str(tmp_path)).collect()} == expected
    formatted = chat.format_conversations(spark.read.parquet(f"{tmp_path}/conversations.parquet"), part_chars=limit)
    assert chat.read_conversations(formatted).count() == len(rows) and chat.format_conversations(formatted.selectExpr("conv_id", "part AS turn", "text AS role", "text").limit(0)).count() == 0
