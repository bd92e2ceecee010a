from dossier.llm import mainpart
from dossier.llm.mainpart import main_text

P = "A long enough paragraph of the article, with some words in it."


def test_wrappers_around_articles_are_no_sign():
    for name in ("form id=aspnetForm", "dialog open", "menu"):
        assert main_text(f"<body><{name}><nav>Top</nav><article><p>{P}</p></article></{name.split()[0]}>") == P
    assert main_text(f"<article><p>{P}</p></article><form><p>Your address here, please. Send it now.</p></form>") == P


def test_comments_and_teasers_are_left_out():
    extra = "<section id=respond><p>Nice article, thank you very much for it.</p></section><article class='teaser'><p>Read this other story about things now.</p></article>"
    assert main_text(f"<article><p>{P}</p></article>{extra}") == P
    assert main_text(f"<article class=comment><p>{P}</p></article><article><p>Short.</p></article>") == "Short."


def test_blocks_hold_their_whole_text():
    assert main_text(f"<article><p>{P}</p><p>one<br>two<br/> three</p><p>E is <math><mi>m</mi> <mo>=</mo> <mn>2</mn></math> so.</p></article>") == f"{P}\none two three\nE is m = 2 so."
    link = "<p><a href=x>See the full report here</a></p>"
    assert main_text(f"<article><p>{P}</p>{link}<p>{P}</p></article>") == f"{P}\nSee the full report here\n{P}"


def test_windows_decide_on_marked_pages_too(monkeypatch):
    page = f"<article><p>Short start.</p></article>{f'<p>{P}</p>' * 6}<p>All rights reserved.</p>"
    assert main_text(page).split("\n")[:7] == ["Short start.", *[P] * 6]
    few = f"<article><p>{P * 9}</p></article><p>All rights reserved.</p><div>More</div>"
    assert main_text(few) == P * 9  # text outside that is too little to surge
    monkeypatch.setattr(mainpart, "line_blocks", lambda weights, least, window=1: [(0, 1)])
    assert main_text(page) == "Short start."
