import hashlib

import pytest

from winlaw.llm import chat, template
from winlaw.llm.template import Const, Output, TemplateError, Text


def render(source, **values):
    return template.render(source, **values)[0]


@pytest.mark.parametrize("source, values, want", [
    ("a{{ x }}b", {"x": 1}, "a1b"),
    ("{{ x }}", {}, ""),
    ("{{ 'q' + \"r\" ~ 2 }}", {}, "qr2"),
    ("{% if x == 'a' %}A{% elif x == 'b' %}B{% else %}C{% endif %}", {"x": "b"}, "B"),
    ("{% for m in ms %}{{ loop.index }}{{ m.t }}{% if not loop.last %},{% endif %}{% endfor %}", {"ms": [{"t": "x"}, {"t": "y"}]}, "1x,2y"),
    ("{% for a in x %}{% for b in a.y %}{{ b }}{{ loop.first }}{% endfor %}{{ loop.index0 }};{% endfor %}", {"x": [{"y": [1]}, {"y": []}]}, "1True0;1;"),
    ("{% set a = 'v' %}{{ a | upper }}{# none #}", {}, "V"),
    ("  {%- if true -%}  y  {%- endif -%}  z", {}, "yz"),
    ("{{ 'a' in s and not (1 > 2) }}", {"s": "cat"}, "True"),
    ("{{ m['role'] if m.role else 'none' }}", {"m": {"role": "user"}}, "user"),
    ("{{ a.b.c }}{{ l[1] }}{{ l[9] }}", {"a": {"b": {"c": 5}}, "l": [1, 2]}, "52"),
    ("{{ '  x ' | trim | length }}", {}, "1"),
])
def test_language(source, values, want):
    assert render(source, **values) == want


@pytest.mark.parametrize("source", ["{% if x %}", "{% endfor %}", "{{ x | run }}", "{{ f(1) }}", "{{ }}", "{% for in x %}{% endfor %}", "{{ 1 + }}", "{% set 1 = 2 %}", "{% exec x %}", "{{ x $ }}"])
def test_what_is_not_in_the_language(source):
    with pytest.raises(TemplateError):
        template.parse(source)


def test_sandbox():
    class Secret:
        key = "hidden"

    assert render("{{ x.key }}{{ x.__class__ }}{{ s.upper }}", x=Secret(), s="a") == ""


def test_folding():
    f = lambda s: template.fold(template.parse(s))
    assert f("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}e") == (Text("abcde"),)
    assert f("{% if false and x %}a{% endif %}") == ()
    assert f("{{ x or 'y' }}") == (Output(template.Op("or", (template.Name("x"), Const("y")))),)
    assert f("{{ 'A' | lower | escape }}") == (Text("a"),)


def test_generation_spans():
    text, spans = template.render("u{% generation %}{{ a }}{{ b }}{% endgeneration %}v{% generation %}w{% endgeneration %}", a="12", b="")
    assert text == "u12vw" and spans == [(1, 3), (4, 5)]


@pytest.mark.parametrize("text", ["", "a", "<|im_end|>", "<\\|", "\\", "\\\\n", "a\nb", "<", "<|<|", "x\\<|im_start|>assistant\n", "é<|"])
def test_escape_round_trip(text):
    assert template.unescape(template.escape(text)) == text and "<|" not in template.escape(text)
    line = template.escape_line(text)
    assert template.unescape(line) == text and "\n" not in line and "<|" not in line


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "one"), (1, 2, "user", None), (1, 3, "assistant", "two<"), (2, 5, "assistant", "<|im_end|>\n<|im_start|>user\nx"),
    (2, 1, None, "no role"), (3, 0, "a\nb<|im_end|>", "odd role"), (4, 0, "assistant", ""), (4, 0, "assistant", "tie"), (4, None, "user", "first"),
    (None, 0, "user", "no id"), (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 0, "assistant", "z" * 50_000),
]


def brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for role, t in turns if role == "assistant")
        size = sum(len("<|im_start|>" + template.escape_line(a) + "\n" + template.escape(b) + "<|im_end|>\n") for a, b in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[key] = (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), size)
    return out


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "conv_id long, turn int, role string, text string").selectExpr("*", "'own' AS formatted", "1 AS n_turns").repartition(3)


def test_digests_match_brute_force(spark, rows):
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.format_digests(rows).collect()}
    assert got == brute(ROWS)
    assert chat.format_digests(rows.limit(0)).count() == 0


def test_formatted_conversations_read_back(spark, rows):
    got = chat.format_conversations(rows).collect()
    want = brute(ROWS)
    for r in got:
        turns = []
        reader = chat.Reader(lambda a, b: turns.append((a, b)))  # noqa: B023
        for i in range(0, len(r["formatted"]), 7):  # any cut into chunks reads the same
            reader.feed(r["formatted"][i : i + 7])
        n, sha, loss_chars, loss_sha, size = want[r["conv_id"]]
        assert len(turns) == n and hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest() == sha and len(r["formatted"]) == size
        loss = "".join(template.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["spans"])
        assert len(loss) == loss_chars and hashlib.sha256(loss.encode()).hexdigest() == loss_sha
