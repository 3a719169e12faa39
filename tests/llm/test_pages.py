"""Page shapes, hostile pages, and the scoring against a slow version written from its definition."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlark.llm import html_text as H

A = "This is the first paragraph of the article, long enough to count, with commas, and so on."
B = "A second paragraph follows, and it is about as long as the first one, give or take a word."
TEXT = f"<p>{A}</p><p>{B}</p>"
WANT = f"{A}\n\n{B}"


@pytest.mark.parametrize("page", [
    '<article class="post has-comments">{}</article>', '<div class="no-ads page"><article>{}</article></div>', '<div class="notice-board">{}</div>', '<div class="discussion-paper">{}</div>', '<div class="commentary">{}</div>', '<div class="subscriber-story">{}</div>',
    '<form id="aspnetForm">{}</form>', '<form><div class="nav">x</div><h1 hidden>x</h1>{}</form>', '<article>{}</article><form><p>Write to us, at any time of the day, about whatever you like to say.</p><p>We read it all, we answer most of it, and we keep none of it for long.</p><p>Your address is not shown to anyone, now or later, here or elsewhere.</p></form>', '<form><main>{}</main></form>', '<form class="search"><input></form><article>{}</article>', '<div class="site-header"><article>{}</article></div>', '<div class="comments-page"><article>{}</article></div>', '<div class="without-sidebar">{}</div>',
    '<div class="ad">buy this, now, cheap, good, very good</div><article>{}</article>', '<div class="top-ad">buy this, now</div><div id="content">{}</div>', '<div class="AdBox">buy, buy</div><div>{}</div>', '<div>{}</div><div class="user-comments"><p>one, two, three, four, five, six, seven, eight</p></div>', '<div>{}</div><section id="comments-list"><p>one, two, three, four, five, six</p></section>',
    '<article>{}</article><div class="related-posts"><article><p>Another story, somewhere else, with some text in it, too.</p></article></div>', '<article>{}</article><section id="comments"><article><p>nice, very nice, I say, and more of that, and more</p></article></section>', '<article>{}<article class="comment"><p>nice, very nice, I say</p></article></article>',
    '<article>{}<footer>by me</footer></article>', '<article>{}<aside><p>did you know, that, this, and more</p></aside></article>', '<article>{}<form><p>Sign up, now.</p><input></form></article>', '<nav><p>menu, menu, menu, menu, and more of it, all of it</p></nav><main>{}</main>', '<main>{}<div class="cookie-notice">We use cookies, many, many.</div></main>',
    '<div hidden><p>not, to, be, seen, by, anyone, at all</p></div><div>{}</div>', '<div style="display: none"><p>a, b, c, d, e, f, g</p></div><div>{}</div>', '<div role="navigation"><p>a, b, c, d, e, f, g</p></div><div>{}</div>', '<article>{}<ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>', '<table><tr><td><div>{}</div></td><td class="sidebar"><p>left, right, up, down, all of it</p></td></tr></table>',
    '<div><!-- a comment with <p>text</p> -->{}</div>', '<div><![CDATA[]]>{}</div>', '<article>{}</article><!-- no end <p>x</p>', '<section class="content-with-ads">{}</section>',
])
def test_shapes(page):
    assert H.main_text(f"<html><head><title>t</title></head><body>{page.format(TEXT)}</body></html>") == WANT


@pytest.mark.parametrize(("kind", "names"), [
    (H.COMMENTED, "comment comments user-comments comment-list commentlist comments_area disqus_thread readerComments fb-comments reply-form"), (H.NOTICED, "ad ads ad-slot-1 AdBox adslot topad google-ads adsbygoogle sponsored-links sponsoredlinks cookie-notice cookiebar gdpr newsletter-signup-form related-posts relatedposts recommended popup"),
    (H.FRAMED, "sidebar sidebar-left leftsidebar siteFooter page-header headerbar nav main-menu mainnav breadcrumbs widget-area social-share socialshare cookie-consent-banner pagination skip-link"),
    (0, "content post article has-comments no-ads comments-open ad-free with-sidebar notice-board noticeboard discussion-paper commentary download thread head read breadth navy header-image search-results relatedness advice address shadow sidebarless 42 entry-content"),
])
def test_names(kind, names):
    assert {n: H.named(n) for n in names.split()} == dict.fromkeys(names.split(), kind)


def test_own_title_stays():
    assert H.main_text(f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1><p>by someone, today</p><nav>x</nav></header>{TEXT}</article></body>") == f"Title\n\n{WANT}"
    assert H.main_text(f'<article><div class="post-header"><h1>Title</h1><span>share</span></div>{TEXT}</article>') == f"Title\n\n{WANT}"


def test_siblings_by_score():
    assert H.main_text(f"<div><article>{TEXT}</article><article><p>{A}</p></article><article><p>x</p></article></div>") == f"{WANT}\n\n{A}"
    assert H.main_text(f"<div><div>{TEXT}</div><p>Short, and no link.</p><p><a>all link</a></p><div><a>link, link, link</a></div></div>") == f"{WANT}\n\nShort, and no link."


SECTION = '<main><section id="intro"><h2>Intro</h2>{text}</section><{tag} {name}><h2>{head}</h2>{body}</{tag}></main>'


@pytest.mark.parametrize("name", "discussion responses reply notice notices related subscription promotion recommendation recommendations consent overlay social search".split())
@pytest.mark.parametrize("tag", ["section", "div"])
def test_sections_of_the_article_stay(name, tag):
    for attribute in (f'id="{name}"', f'class="part {name.title()}"'):
        page = SECTION.format(text=TEXT, tag=tag, name=attribute, head=f"On {name}", body=TEXT)
        assert H.main_text(page) == f"Intro\n\n{WANT}\n\nOn {name}\n\n{WANT}"


@pytest.mark.parametrize(("name", "head", "body"), [
    ("discussion", "3 Responses", TEXT), ("discussion", "Reader discussion", TEXT), ("responses", "Leave a reply", TEXT), ("notice", "Cookies", TEXT), ("discussion", "Discussion", f'{TEXT}<div class="comment"><p>nice</p></div>'), ("related", "Related", f"<p><a>{A}</a></p><p><a>{B}</a></p>"),
    ("notice", "Notice", f"<p>{A}</p>"), ("responses", "What you think", f"<time>today</time>{TEXT}"), ("subscription", "Get more", f"{TEXT}<form><input></form>"), ("discussion", "Your words", f"<div>{TEXT}</div><div>{TEXT}</div><div>{TEXT}</div>"), ("comments", "Discussion", TEXT), ("discussion ad", "Discussion", TEXT),
])
def test_marked_sections_of_other_shapes_go(name, head, body):
    assert H.main_text(SECTION.format(text=TEXT, tag="section", name=f'class="{name}"', head=head, body=body)) == f"Intro\n\n{WANT}"


def test_short_parts_between_kept_ones_stay():
    assert H.main_text(f"<div><div>{TEXT}</div><div><h2>Middle</h2><p>Short.</p></div>and <b>bold</b> words<div><a>link</a></div><div><p>{A}</p></div></div>") == f"{WANT}\n\nMiddle\n\nShort.\n\nand bold words\n\n{A}"
    assert H.main_text(f"<main><h1>T</h1><article>{TEXT}</article><article><p>Short.</p></article><article><a>More</a></article><p>End.</p></main>") == f"T\n\n{WANT}\n\nShort.\n\nEnd."


def test_lists_of_links_with_their_headings():
    links = "<li><a>one</a><li><a>two</a><li><a>three</a>"
    assert H.main_text(f"<article>{TEXT}<h2>References:</h2><ul>{links}</ul></article>") == f"{WANT}\n\nReferences:\n\none\n\ntwo\n\nthree"
    assert H.main_text(f"<article>{TEXT}<ol>{links}</ol></article>") == f"{WANT}\n\none\n\ntwo\n\nthree"
    assert H.main_text(f"<article>{TEXT}<h2>More stories</h2><ul>{links}</ul></article>") == WANT
    assert H.main_text(f"<article><h1>Title</h1><ul>{links}</ul>{TEXT}</article>") == f"Title\n\n{WANT}"


@pytest.mark.parametrize("unit", ["<h2><section id=discussion><p>" + A + "</p><p>" + A + "</p>", "<main><section class=notice><h2>x</h2>", "<article>", "<!", "<![CDATA[", "<a x=\"", "<ul><li>", "<div class=ad><article>", "<form><h1>x", "<header><h1>x", "<b><p>", "<td>", "</p>", "<!-- ", "<script>", "<a b=\"", "<a b='<\"' ", "<a b=\"<c d='\" ", "<a b=' \"<", "<a" + "a" * 5000 + " "])
def test_hostile_pages_take_linear_time(unit):
    def took(n):
        began = time.process_time()
        H.main_text(unit * (n // len(unit)))
        return time.process_time() - began

    took(10_000)
    small, large = took(100_000), took(800_000)
    assert large < 24 * small + 1.0  # eight times the page; quadratic work would be 64 times


def test_a_long_name_takes_linear_time():
    began = time.process_time()
    assert H.main_text("<" + "a" * 1_000_000) == "<" + "a" * 1_000_000
    assert time.process_time() - began < 5


@pytest.mark.parametrize(("html", "want"), [
    ('<p title="a < b">Text</p>', "Text"), ("<img alt='1 < 2' src=x><p>One</p>", "One"), ('<p data-x="a<b">Text</p>', "Text"), ('<p a = "x > y < z" class=c>Text</p>', "Text"), ("<a href='u\"<v'>link</a>", "link"), ('<p a="<"b="<">Text</p>', '<p a="<"b="<">Text'),
    ('<p title="abc>Text</p><p class="x">More</p>', "Text\n\nMore"), ("a < b <p>x</p>", "a < b\n\nx"), ('<p title="<b>bold</b>" hidden>gone</p><p>Text</p>', "Text"), ('<p title="<" class="ad">gone</p><p>Text</p>', "Text"), ('<p title="a <\nb"/>Text', "Text"),
])
def test_markup_in_attributes(html, want):
    assert H.main_text(html) == want


def naive(root):
    """worth() of every element that gets points, by recursion over whole subtrees at each element."""
    def kids(x):
        return [b for b in x.below if isinstance(b, str) or not b.off]

    def chars(x, linked=False, only_linked=False):
        linked = linked or x.tag == "a"
        return sum((len(b.strip()) if linked or not only_linked else 0) if isinstance(b, str) else chars(b, linked, only_linked) for b in kids(x))

    def commas(x):
        return sum(sum(b.strip().count(c) for c in ",、，") if isinstance(b, str) else commas(b) for b in kids(x))

    def under_link(x):
        return x is not None and (x.tag == "a" or under_link(x.up))

    def share(x):
        n = chars(x)
        return chars(x, under_link(x.up), True) / n if n else 0.0

    points = {}

    def visit(x):
        direct = [b.strip() for b in kids(x) if isinstance(b, str) and b.strip()]
        if chars(x):
            own = None
            if x.tag in H.PARAGRAPH:
                own, n, c = x.up, chars(x), commas(x)
            elif x.tag in H.HOLDS_TEXT and direct:
                own, n, c = x, sum(map(len, direct)), sum(d.count(",") for d in direct)
            level = 0
            while own is not None and level < 5 and own.tag not in ("#root", "html"):
                gain = (min(n / 100, 3) + c + (n >= 25)) * (1 - share(x))
                points[id(own)] = points.get(id(own), 0) + gain / {0: 1, 1: 2}.get(level, level * 3)
                own, level = own.up, level + 1
        for b in kids(x):
            if not isinstance(b, str):
                visit(b)

    visit(root)
    return {x: p * (1 - share(x)) for x in H.elements(root) if (p := points.get(id(x))) is not None}


piece = st.sampled_from(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<ul><li>", "</ul>", "<b>", "</b>", "<section>", "</section>", "<article>", "</article>", "<nav>", "</nav>", "some text, with commas, and more words to count", "short ", "、", "<td>", "<h2>", "</h2>", "<div class=ad>"])


@settings(max_examples=200, deadline=None)
@given(st.lists(piece, max_size=25))
def test_scores_are_those_of_the_slow_version(parts):
    root = H.tree("".join(parts))
    H.decide(root)
    want = naive(root)
    H.measure(root)
    got = {x: H.worth(x) for x in H.score(root)}
    assert set(got) == set(want)
    assert all(abs(got[x] - want[x]) < 1e-9 for x in want)


@pytest.mark.parametrize("n", [10, 998, 1100])
def test_how_many_articles_comments_hold_changes_nothing(n):
    talk = '<div class="comments"><article><p>nice, very nice, I say, and more of that, and more words</p></article>' + "<article><p>x</p></article>" * n + "</div>"
    assert H.main_text(f'<body>{talk}<div class="sidebar"><main>{TEXT}</main></div></body>') == WANT
