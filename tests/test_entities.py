"""Character references against the standard library's decoder."""

import html
import re
from html.entities import name2codepoint

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from helpers import apply
from pagesieve.functions import decode_entities


def test_every_known_name_and_number(spark):
    # Numbers that the standard library turns into nothing have their own test.
    points = [9, 32, 34, 38, 39, 60, 8362, 0x5D0, 0x1F600, *range(130, 260)]
    texts = [f"a&{name};b" for name in name2codepoint] + [
        form.format(point)
        for point in points
        if point not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)
        for form in ("x&#{};", "x&#x{:x};y", "&#X{:X};y")
    ]
    assert apply(spark, decode_entities, texts) == [html.unescape(t) for t in texts]


def test_control_characters_stay(spark):
    texts = ["a&#127;b", "a&#x81;b", "a&#1114111;b"]
    assert apply(spark, decode_entities, texts) == ["a\x7fb", "a\x81b", "a\U0010ffffb"]


def test_decodes_once_and_leaves_the_rest(spark):
    cases = {
        "&amp;lt; &amp;amp;": "&lt; &amp;",
        "&amp;#60;": "&#60;",
        "&nope; & &; &amp &# &#; &#x;": "&nope; & &; &amp &# &#; &#x;",
        "&&amp;&": "&&&",
        "&#0;|&#xD800;|&#1114112;": "�|�|�",
        "": "",
        "no references": "no references",
    }
    assert apply(spark, decode_entities, list(cases)) == list(cases.values())
    assert apply(spark, decode_entities, [None]) == [None]


_KNOWN = ["&amp;", "&lt;", "&quot;", "&middot;", "&#8362;", "&#x5d0;"]
_OTHER = ["&", ";", "amp", "&nope;", " ", "a", "ש", "<b>", "="]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(_KNOWN + _OTHER), max_size=12), min_size=50, max_size=80))
def test_random_text(spark, token_lists):
    texts = ["".join(tokens) for tokens in token_lists]
    known = re.compile("|".join(map(re.escape, _KNOWN)))
    expected = [known.sub(lambda m: html.unescape(m[0]), t) for t in texts]
    assert apply(spark, decode_entities, texts) == expected
