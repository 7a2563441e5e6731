"""Pages that nest deeply or leave end tags out give their whole main text."""

from anamnesis.llm.html_text import nodes_of, parsed, text_from


def whole(page):
    root = parsed(page)
    nodes = nodes_of(root)
    return text_from(root, {id(n) for n in nodes}), max(n.depth for n in nodes)


def test_deep_nesting():
    text, depth = whole("<div>" * 5000 + "core" + "</div>" * 5000 + "<p>end")
    assert text == "core\nend" and depth == 5000


def test_implied_end_tags():
    rows = "".join(f"<tr><td>a{k}<td><p>b{k}" for k in range(1500))
    text, depth = whole(f"<table>{rows}</table><p>after")
    assert depth == 4 and text.split("\n") == [x for k in range(1500) for x in (f"a{k}", f"b{k}")] + ["after"]
    assert whole("<dl>" + "<dt>t<dd><p>d" * 1500 + "</dl>")[1] == 3
    assert whole("<ul>" + "<li><p>x" * 1500 + "</ul>")[1] == 3
    assert whole("<table><tbody><tr><td>a<tbody><tr><th>b</table>")[1] == 4
    # an inner table or list closes nothing of the outer one
    root = parsed("<table><tr><td><table><tr><td>in</table>rest<td>next</table><ul><li>a<ul><li>b</ul>c<li>d</ul>")
    table, items = root.children
    assert [c.tag for c in table.children[0].children] == ["td", "td"] and [c.tag for c in items.children] == ["li", "li"]
    assert table.children[0].children[0].children[0].tag == "table"
