"""Visible text of rows outside of plain tables, and of rules that hold on other media."""

import pytest

from lumirel.llm import html_text

ROW = "<tr><td>a</td><td>bb</td></tr>"
NEXT = "<tr><td>ccc</td><td>d</td></tr>"


@pytest.mark.parametrize("wrapper", ["form", "div", "center", "section", "blockquote"])
def test_rows_within_wrappers_belong_to_their_table(wrapper):
    assert html_text.render(f"<table><{wrapper}>{ROW}</{wrapper}>{NEXT}</table>") == "a    bb\nccc  d"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (ROW, "a  bb"),
        (f"x {ROW} {NEXT} y", "x\na    bb\nccc  d\ny"),
        (f"<table>{ROW}</table>{NEXT}", "a  bb\n\nccc  d"),
        (f"<div>{ROW}</div>", "a  bb"),
        (f"<ul><li>{ROW}</li>{NEXT}</ul>", "- a  bb\nccc  d"),
        (f"<tbody>{ROW}{NEXT}</tbody>", "a    bb\nccc  d"),
        (f"<table><div>x{ROW}y<p>z</p></div></table>", "x\ny\n\nz\na  bb"),
        (f"<table><ul><li>{ROW}</li></ul></table>", "- a  bb"),
        (f"<table><tr><td><div>{ROW}</div></td><td>z</td></tr></table>", None),
        (f"<table><tr><td><table><form>{ROW}</form></table></td><td>z</td></tr></table>", None),
    ],
)
def test_no_cell_vanishes(source, text):
    out = html_text.render(source)
    assert all(x in out.split() for x in ("a", "bb"))
    assert text is None or out == text


@pytest.mark.parametrize(
    ("sheet", "seen"),
    [
        ("@media print{nav{display:none}}", True),
        ("@media (max-width:600px){nav{display:none}}", True),
        ("@media screen and (max-width:600px){nav{display:none}} p{color:red}", True),
        ("@media print{p{color:red} nav{display:none}}", True),
        ("@media print{@media screen{nav{display:none}}}", True),
        ("@supports (display:grid){nav{display:none}}", True),
        (".x{nav{display:none}}", True),
        ("@media print{p{color:red}} nav{display:none}", False),
        ("@media screen{p{color:red} nav, aside{display:none}}", False),
        ("@media only screen, print{nav{display:none}}", False),
        ("@media all{@media screen{nav{display:none}}}", False),
        ("@layer base{nav{display:none}}", False),
        ("@import 'x.css'; nav{color:red;display:none}", False),
        ("p::after{content:'}'} nav{display:none}", False),
        ("nav{color:red;&:hover{color:blue}display:none}", False),
    ],
)
def test_media_rules_hide_only_where_they_hold(sheet, seen):
    assert ("menu" in html_text.render(f"<style>{sheet}</style><nav>menu</nav><p>text</p>")) == seen


def test_media_of_a_style_element():
    assert html_text.render("<style media=print>nav{display:none}</style><nav>menu</nav>") == "menu"
    assert html_text.render("<style media=screen>nav{display:none}</style><nav>menu</nav>x") == "x"
