"""Block rules on pages whose article element doesn't say it all."""

from screenflow.llm.html import main_text

PROSE = "This is the text of the page, which is long enough to be judged and has the words that we need in it, so it stays with the rest of it. "
KEYWORDS = "shoes bags hats coats gloves scarves boots belts shirts trousers jackets dresses sandals slippers " * 2


def test_body_beside_teaser_cards():
    card = "<article><h3><a href=x>Other story</a></h3><p>Read it now.</p></article>"
    page = f"<body><div><h1>Title</h1><p>{PROSE}<p>Yes.<p>{PROSE}</div><div>{card * 3}</div></body>"
    assert main_text(page) == f"Title\n\n{PROSE.strip()}\n\nYes.\n\n{PROSE.strip()}"


def test_notices_and_word_lists_inside_the_article():
    page = f"<article><p>{PROSE}<p class='ad'>{PROSE}Buy.</p><p>Short.<p>{KEYWORDS}<p>{PROSE}<h2 class=related>See also</h2></article>"
    assert main_text(page) == f"{PROSE.strip()}\n\nShort.\n\n{PROSE.strip()}"


def test_article_without_known_words():
    page = f"<div>Notice</div><article><h1>Shop</h1><p>{KEYWORDS}<pre>{KEYWORDS}</pre></article><div>{PROSE}</div>"
    assert main_text(page).startswith(f"Shop\n\n{KEYWORDS.strip()}\n\n{KEYWORDS.strip()}")


def test_elements_without_an_end_tag_cut_nothing():
    p = PROSE.strip()
    for loose in ("<svg viewBox='0' />", "<button>Buy", "<select><option>One", "<object data=x>", "<title-bar>", "<button-group>", "<select-box>", "<SVG/>"):
        assert main_text(f"<article><p>{p}</p>{loose}<p>{p}</p></article>") == f"{p}\n\n{p}", loose
    assert main_text(f"<article><p>{p} <svg><title/><path d=x /></svg><b>icon</b></p><p>{p}</article>") == f"{p} icon\n\n{p}"


def test_skipped_elements_and_raw_text():
    p = PROSE.strip()
    for gone in ("<button><div>Buy</div></button>", "<svg><g><svg/></g><text>Pic</text></svg>", "<script>if (a<b) '<p>no'</script >", "<object><object>In</object>out</object>", "<style>p{}</style>"):
        assert main_text(f"<article><p>{p}</p>{gone}<p>{p}</p></article>") == f"{p}\n\n{p}", gone
    assert main_text(f"<article><p>{p}</p><script>{p}") == p


BODY = f"<article><h1>Title</h1><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p></article>"
FULL = f"Title\n\n{PROSE.strip()}\n\nYes.\n\n{PROSE.strip()}"
COMMENTS = f"<p>{PROSE} So says a reader.</p>" * 4


def test_names_of_outer_elements_keep_the_article():
    for name in ("layout has-sidebar", "no-sidebar content", "single-post comments-open", "page-wrap with-banner", "post-share-count", "entry related-posts-on"):
        assert main_text(f"<body><div class='{name}'>{BODY}</div></body>") == FULL, name
        plain = BODY.replace("article>", "section>")
        assert main_text(f"<body><div class='{name}'><div>{plain}</div></div></body>") == FULL, name
    assert main_text(f"<article><p>{PROSE}</p><p class=alert-box-free>Kept as it is.</p><h2 class=copyright-law>The law</h2><p>{PROSE}</p></article>").count("\n\n") == 3


def test_evidence_falls_for_what_holds_the_article_or_all_text():
    p = PROSE.strip()
    for wrap in ("<form id=aspnet>{}</form>", "<div class=widget>{}</div>", "<div role=dialog>{}</div>", "<aside>{}</aside>", "<div id=main-content class='sidebar'>{}</div>"):
        assert main_text(wrap.format(BODY)) == FULL, wrap
        assert main_text(wrap.format(f"<div><p>{PROSE}</p></div>") + "<div>Small print.</div>").startswith(p), wrap


def test_whole_names_still_keep_their_blocks_out():
    for name in ("comments", "site-footer", "cookie-notice", "related-posts", "sidebar", "siteFooter", "ad-slot", "social-share", "newsletter_signup", "comment-list"):
        for body in (BODY, BODY.replace("article>", "div>")):
            assert main_text(f"{body}<div class='{name}'>{COMMENTS}</div>") == FULL, name
    # Comments that are articles of their own, and longer than the body.
    each = f"<article class=comment>{COMMENTS}</article>" * 3
    assert main_text(f"{BODY}<div id=comments>{each}</div>") == FULL
    assert main_text(f"{BODY.replace('article>', 'div>')}<div id=comments>{COMMENTS}</div>") == FULL
    for gone in (f"<nav>{COMMENTS}</nav>", f"<footer>{COMMENTS}</footer>", f"<div hidden>{COMMENTS}</div>", f"<div role=navigation>{COMMENTS}</div>"):
        assert main_text(BODY + gone) == FULL
        assert main_text(gone) == "", gone


ITALIAN = (
    "Il gatto dorme sopra il tetto mentre gli uccelli cantano nel giardino della casa vicina, dove i bambini giocano ogni pomeriggio fino al "
    "tramonto insieme ai nonni che raccontano vecchie storie di mare e di montagna."
)
CHINESE = "今天早上我们去了附近的公园散步，看到很多老人正在树下打太极拳，孩子们则在草地上放风筝，空气清新，阳光明媚，大家都非常高兴，决定下个星期天再来这里野餐，并且邀请更多的朋友一起参加。"


def test_languages_without_stop_words_here():
    page = f"<body><div><a href=x>Casa</a></div><div><h1>Titolo</h1><p>{ITALIAN}</p><p>Breve.</p><p>{ITALIAN}</p></div></body>"
    assert main_text(page).endswith(f"Titolo\n\n{ITALIAN}\n\nBreve.\n\n{ITALIAN}")
    page = f"<body><div><h1>公园</h1><p>{CHINESE}</p><p>{CHINESE}</p></div><div><p>{PROSE}</p></div></body>"
    assert CHINESE in main_text(page) and main_text(page).count(CHINESE) == 2
    links = f"<ul>{''.join(f'<li><a href=x>{ITALIAN}</a></li>' for _ in range(3))}</ul>"
    assert main_text(f"<div><p>{ITALIAN}</p></div>{links}") == ITALIAN


def test_very_long_pages():
    page = f"<article>{f'<p>{PROSE}</p>' * 20_000}</article>"
    assert len(main_text(page)) == 20_000 * (len(PROSE.strip()) + 2) - 2
    assert main_text("<div class=comments>" * 3000 + PROSE * 30) == (PROSE * 30).strip()
