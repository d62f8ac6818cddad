"""Class and id words are hints: they never take the article, a heading or a part with a name of its own."""

import pytest

ARTICLE = "<h1>Title {i}</h1><p>First words of page {i} run on.</p><p>More of page {i}, and its end.</p>"


def texts(spark, wrap, n=12):
    from cohortspark.llm.wrapper import extract

    rows = [(i, f"https://h.example/{i}", "<html><body><nav>Home</nav>" + wrap.replace("@", ARTICLE.format(i=i)).replace("#", str(i)) + "<footer>End</footer></body></html>") for i in range(n)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in got}


WHOLE = "Title {i}\n\nFirst words of page {i} run on.\n\nMore of page {i}, and its end."


@pytest.mark.parametrize("wrap", [
    "<div class='content no-sidebar'>@</div>", "<div class='content-sidebar-wrap'>@</div>",
    "<article class='post comment-status-open'>@</article>", "<div class='banner'><main>@</main></div>", "<div id='sidebar'>@</div>",
    "<article>@<div class='comments'><p>Reader # says no.</p></div></article>", "<article>@</article><div class='related-posts'><p>See # too</p></div>",
])
def test_article_comes_out_whole(spark, wrap):
    assert texts(spark, wrap) == {i: WHOLE.format(i=i) for i in range(12)}


@pytest.mark.parametrize("part, kept", [
    ("<h2 id='search'>Search of #</h2>", True), ("<section id='related-work'><p>Others did #</p></section>", True),
    ("<p title='the hidden gem x'>A gem #</p>", True), ("<p hidden>Secret #</p>", False), ("<p hidden=''>Secret #</p>", False),
    ("<div class='share-buttons'>Send #</div>", False), ("<div class='cookie-banner'>Eat #</div>", False),
])
def test_parts_of_an_article(spark, part, kept):
    got = texts(spark, f"<article>@{part}</article>")
    for i, text in got.items():
        inside = part[part.index(">", 3 if "<section" not in part else 30) + 1 : part.rindex("#")].replace("<p>", "")
        assert (f"{inside}{i}" in text) == kept and text.startswith(WHOLE.format(i=i))
