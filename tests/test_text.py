from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from paceline.functions import text

SPACES = ["", " ", "\n\t x   ", "a　b", "\x1c\x1fq\x85", "plain", "​not a space​"]


def test_strip_and_words_follow_the_unicode_definition(column):
    assert column(text.strip("text"), SPACES) == [s.strip() for s in SPACES]
    assert column(text.words("text"), SPACES) == [s.split() for s in SPACES]


def test_lines_split_at_every_line_break(column):
    samples = ["", "  ", "a\r\nb\rc\n\nd", "x y\x0bz\x85w\n", " one "]
    assert column(text.lines("text"), samples) == [s.strip().splitlines() for s in samples]


def test_finite_number_is_stricter_than_a_cast(column):
    samples = ["1", " -2.50 ", "1e3", ".5", "5.", "1d", "nan", "inf", "1_000", "1__0", "", "0x1", "+3", "1 2"]

    def wanted(s):
        try:
            value = float(s)
        except ValueError:
            return None
        return value if value == value and abs(value) != float("inf") else None

    assert column(text.finite_number("text"), samples) == [wanted(s) for s in samples]


def test_strip_cpp_comments(column):
    # Each with what must be left; a line comment ends at a line feed and at nothing else.
    cases = {
        " a; /* x\ny */ b; // c\nd; ": "a;  b; \nd;",
        'puts("http://x");\n/**/z': 'puts("http:\nz',
        "/* open": "/* open",
        "a // one\u2028two\nb": "a \nb",
        "/*a*/ k /*b*/": "k",
        "// only": "",
        "": "",
    }
    assert column(text.strip_cpp_comments("text"), list(cases)) == list(cases.values())


def test_render_template_sees_text_put_in_early(column):
    rendered = text.render_template("[{{  a  }}|{{  b  }}]", {"a": "text", "b": F.lit("B")})
    assert column(rendered, ["x", "{{  b  }}"]) == ["[x|B]", "[B|B]"]
    # In the other order the early text is not scanned again.
    swapped = text.render_template("[{{  a  }}|{{  b  }}]", {"b": F.lit("B"), "a": "text"})
    assert column(swapped, ["{{  b  }}"]) == ["[{{  b  }}|B]"]


def test_split_at_marker(column):
    samples = ["do MARK it MARK", "no mark", "MARK", ""]
    assert column(text.before_marker("text", "MARK"), samples) == ["do ", "no mark", "", ""]
    assert column(text.from_marker("text", "MARK"), samples) == ["MARK it MARK", None, "MARK", None]


FENCED = [
    "x ```cpp\nint a;\n``` y ```cpp\nint b;\n```",
    "```\nbare\n```",
    "```python\nno\n```",
    "```cpp\n\n```",
    "```cpp   int c;```",
    "none",
]


def test_code_extraction(column):
    assert column(text.extract_first_code_chunk("text"), FENCED) == ["int a;", "bare", None, "", None, None]
    assert column(text.extract_last_code("text", "cpp"), FENCED) == ["int b;\n", "No Code", "No Code", "\n", "No Code", "No Code"]
    assert column(text.extract_last_code("text", "cpp", ""), FENCED)[-1] == ""
    assert column(text.extract_fenced_trimmed("text"), FENCED) == ["int a;\n", "", "", "", "int c;", ""]


def test_tag_block_and_stop(column):
    samples = ["a [SUGG/] x\n y [/SUGG] [SUGG/]z[/SUGG]", "[SUGG/] open", "[SUGG/][/SUGG]"]
    assert column(text.extract_tag_block("text"), samples) == ["x\n y", None, ""]
    assert column(text.truncate_at_stop("text"), samples) == ["a [SUGG/] x\n y ", "[SUGG/] open", "[SUGG/]"]


def test_build_messages_keeps_an_empty_row_prompt(spark):
    rows = spark.createDataFrame([(0, "p", ""), (1, "q", None), (2, "r", "s")], "i int, prompt string, sys string")

    def messages(**options):
        built = text.build_messages("prompt", "sys", **options)
        return [[tuple(m) for m in row[0]] for row in rows.select(built, "i").orderBy("i").collect()]

    assert messages() == [
        [("system", ""), ("user", "p")],
        [("user", "q")],
        [("system", "s"), ("user", "r")],
    ]
    assert messages(global_system="g")[1] == [("system", "g"), ("user", "q")]
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        rows.select(text.build_messages("missing")).collect()


def test_relevant_section_cuts_at_the_last_closing_phrase(column):
    end, here = "\n\nBy following these suggestions,", "Here is how the student"
    samples = [
        f"intro - **[A]**: x{end} more - **[B]**: y{end} tail",
        f"- **[A]**: x {here} z {here} w",
        f"- **[A]**: x {here} y{end} z",
        "no bullets",
        f"- **[A]**: only{end}",
    ]
    assert column(text.relevant_section("text"), samples) == [
        f"- **[A]**: x{end} more - **[B]**: y",
        f"- **[A]**: x {here} z ",
        "- **[A]**: x ",
        "",
        "- **[A]**: only",
    ]


def test_strategy_entries_keep_first_place_and_last_content(column):
    cases = {
        "- **[A]**: one\n- **[B]**: two\nmore\n- **[A]**: three": [("A", "three"), ("B", "two\nmore")],
        "- **[ A ]**:  x\n- **[A]**: y": [("A", "y")],
        "- **[A]** no colon\n- **[B]**: kept": [("B", "kept")],
        "- **[A]**: \n- **[B]**: b": [("B", "b")],
        "- **[A [x]]**: nested ]**: twice": [("A [x]", "nested ]**: twice")],
        "": [],
        "text\n- **[Z]**: z": [("Z", "z")],
    }
    got = column(text.strategy_entries("text"), list(cases))
    assert [[tuple(entry) for entry in entries] for entries in got] == list(cases.values())


def test_category_names(column):
    samples = [
        "- **Branching Efficiency**: a\n- **Other**: b\n- **Branching Efficiency**: c"
        "\n\n[End of Optimization Suggestions]\n- **Loop Efficiency Techniques**: d",
        "- **Code Cleaning and Readability Improvements**: x",
        "nothing",
    ]
    assert column(text.category_names("text"), samples) == [["Branching Efficiency"] * 2, [], []]


def test_resolve_category(column):
    samples = [
        " Branching Efficiency \nrest",
        "It is Data Structure Selection, or Algorithm Design Optimization.",
        "first line\nBranching Efficiency",
        "",
    ]
    assert column(text.resolve_category("text"), samples) == [
        "Branching Efficiency",
        "Algorithm Design Optimization",
        "N/A",
        "N/A",
    ]
