"""Page extraction: marked and unmarked articles, layouts, forms, adverts and comments; all given pages against the library's parser."""

from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from siftwell.llm.html_lines import extract

T = "A long paragraph of the article that has many words in it, so that it surges over the bound of eighty characters."
REPLY = "Leave a reply, with words enough to be taken for text, and more than eighty characters long, all in all."
PAGES = [
    (f"<body><nav><a>x</a></nav><main class='content with-sidebar'><p>{T}</p></main></body>", T),
    (f"<body><main id='menu'><p>{T}</p></main></body>", T),
    (f"<body><div class='layout has-sidebar'><article><p>{T}</p><p>Two.</p></article><aside>no</aside></div></body>", f"{T}\nTwo."),
    (f"<body><div class='page sidebar-left'><div class=sidebar>menu {T}</div><article><p>{T}</p></article><p>out</p></div></body>", T),
    (f"<body><form action=x><div><p>{T}</p><p>Two.</p></div><button>no</button></form></body>", f"{T}\nTwo."),
    (f"<body><form action=x><main><p>{T}</p></main><p>{REPLY}</p></form></body>", T),
    (f"<body><form><input><p>Search here</p></form><div><p>{T}</p></div><form><p>{REPLY}</p></form></body>", T),
    (f"<body><article><p>{T}</p><form><p>{REPLY}</p></form><p>End.</p></article></body>", f"{T}\nEnd."),
    (f"<body><article><p>{T}</p><p><a href=x>Only a link</a></p></article></body>", f"{T}\nOnly a link"),
    (f"<body><article><p><a href=x>Only a link</a></p><div class=ad>Buy</div><p>{T}</p></article></body>", f"Only a link\n{T}"),
    (f"<body><div><p>{T}</p><div class=ad>Buy now</div><p>Short.</p></div><footer>foot</footer></body>", f"{T}\nShort."),
    (f"<body><ul><li><a>One</a></li><li><a>Two</a></li></ul><div><p>{T}</p><p><a>More</a></p></div><ul><li><a>Three</a></li></ul></body>", f"{T}\nMore"),
    (f"<body><article><p>{T}</p></article><div class=comments><article><p>{REPLY}</p></article></div></body>", T),
    (f"<body><div class='post-comments'><article><p>{REPLY}</p></article></div><article><p>{T}</p></article></body>", T),
    (f"<body><div class=related><div class='sidebar'><article><p>{REPLY}</p></article></div></div><div><p>{T}</p></div></body>", T),
    ("<body><p><a href=x>Only a link</a></p></body>", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_page(page, text):
    assert extract(page) == text


class Plain(HTMLParser):
    """The article of a page whose markup is as in the given table: one article, adverts of class ad."""

    BLOCKS = {"p", "h1", "h2", "h3", "li", "ul", "div", "article"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside = self.skip = 0
        self.lines = [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "
        if tag == "div":
            self.skip += self.skip > 0 or ("class", "ad") in attrs
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.lines.append("")
        if tag == "div" and self.skip:
            self.skip -= 1
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.lines[-1] += data

    def text(self):
        return "\n".join(t for t in (" ".join(x.split()) for x in self.lines) if t)


def test_all_given_pages():
    pages = pq.read_table("/root/testdata/sf0.1/pages.parquet")["html"].to_pylist()
    assert len(pages) == 2500
    for page in pages:
        assert extract(page) == Plain(page or "").text()
