"""Wrappers tell the article from the rest when no tag or class does."""

import os
import re
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pyarrow.parquet as pq
import pytest

from kernelspark.llm import wrapper

GIVEN = "/root/testdata/sf0.1/pages.parquet"


def without_names(html):
    """All structural tags become div; classes, ids and roles go."""
    html = re.sub(r"<(/?)(?:article|main|nav|header|footer|aside|section|form|menu|figure|dialog)\b[^>]*>", r"<\1div>", html, flags=re.I)
    return re.sub(r"\s(?:class|id|role|itemprop)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)(?=[^<]*>)", "", html)


def rules_of(pages):
    w = wrapper.expression(pages[0])
    for p in pages[1:]:
        w = wrapper.align(w, wrapper.expression(p))
    return wrapper.rules(w, len(pages))


@pytest.mark.skipif(not os.path.exists(GIVEN), reason="the given pages are not here")
def test_given_pages_without_names():
    hosts = defaultdict(list)
    for r in pq.read_table(GIVEN, columns=["url", "html"]).to_pylist():
        hosts[re.sub(r"^(www|m)\.", "", urlsplit(r["url"]).hostname or "")].append(r["html"])
    right, alone, total = 0, 0, 0
    for pages in hosts.values():
        named = [wrapper.parse(h) for h in pages]
        want = [wrapper.text_of(p, rules_of(named)) for p in named]
        bare = [wrapper.parse(without_names(h)) for h in pages]
        assert not any(re.search("article|nav|footer", k.key) for p in bare for k in p.kids)
        rule = rules_of(bare)
        total += len(pages)
        right += sum(wrapper.text_of(p, rule) == t for p, t in zip(bare, want, strict=True))
        alone += sum(wrapper.text_of(p, None) == t for p, t in zip(bare, want, strict=True))
    assert right >= 0.99 * total > alone  # with inference off the same pages fail


BOX = "<body><div><ul><li><a href='/'>Home</a><li><a href='/n'>News {i}</a></ul></div><div>Buy {ad} today</div><div><h1>Title {i}</h1>{story}</div><div>&copy; site, edition {i}</div></body>"


@pytest.mark.parametrize("n", [1, 2, 14])
def test_equal_boxes_are_slots_of_their_own(n):
    story = [[f"Part {i} {k}" + f" word{i}" * (8 + k) for k in range(2 + i % 3)] for i in range(n)]
    pages = [wrapper.parse(BOX.format(i=i, ad=f"offer{i}", story="".join(f"<p>{t}</p>" for t in story[i]))) for i in range(n)]
    rule = rules_of(pages)
    assert [wrapper.text_of(p, rule) for p in pages] == ["\n".join([f"Title {i}", *story[i]]) for i in range(n)]


def test_classes_do_not_drop_blocks_of_text():
    html = "<article><p class='notice-board'>Real text {i}</p><p id='share'>More real text {i}</p><ul class='related'><li class='tags'>An item {i}</li></ul><p class='share'><a href='/s'>Share {i}</a></p></article>"
    pages = [wrapper.parse(html.format(i=i)) for i in range(3)]
    rule = rules_of(pages)
    assert [wrapper.text_of(p, rule) for p in pages] == [f"Real text {i}\nMore real text {i}" for i in range(3)]


@pytest.mark.parametrize("control", ["<button class='x'>Press <b>me</b></button>", "<select><option>One<option selected>Two</select>", "<button>", "<button/>"])
def test_controls_do_not_part_a_line(control):
    page = wrapper.parse(f"<article><p>One {control} two</p><p>Three</p></article>")
    got = wrapper.text_of(page, None)
    assert got in ("One two\nThree", "One\nThree") and (got == "One two\nThree" or control == "<button>")


def test_long_marks_are_told_apart():
    a, b = (wrapper._mark([f"c{w}" * 3 for w in "abcdefghijklmnopqrstuvwxyz"] + [last]) for last in ("one", "two"))
    assert a != b and not wrapper.Tag("div", a).dropped and len(a) < 130
    assert Counter(a.split())[a.split()[0]] == 1
