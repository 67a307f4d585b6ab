from vellum.llm.main_content import body_lines, main_lines, main_text

FRAME = "<div class='x'><div>Cookies on this website</div><button>Accept all</button><ul><li><a href='/1'>Home</a></li><li><a href='/2'>People</a></li><li><a href='/3'>News</a></li></ul></div>"
FOOT = "<div class='y'><div>5 Some Street, Town</div><ul><li><a href='/4'>Imprint</a></li></ul></div>"
BODY = "<h1>Ada Lovelace</h1><p>Professor</p><p>She works on engines and has written notes about them, which many people read.</p><div>Share this page</div><ul><li>A. Lovelace (1843). Notes.</li></ul>"


def page(body):
    return f"<html><head><title>t</title><script>'<li>x</li>'</script></head><body>{FRAME}<div>{body}</div>{FOOT}</body></html>"


def lines_of(body_texts):
    return ["Cookies on this website", "Accept all", "Home", "People", "News", *body_texts, "5 Some Street, Town", "Imprint"]


def test_body_is_found_and_labels_go():
    text = "\n".join(lines_of(["Ada Lovelace", "Professor", "She works on engines and has written notes about them, which many people read.", "Share this page", "A. Lovelace (1843). Notes."]))
    assert body_lines(page(BODY), text) == [6, 7, 8, 10]


def test_blank_lines_are_counted_but_never_body():
    text = "\n\n".join(lines_of(["Ada Lovelace", "Professor", "She works on engines and has written notes about them, which many people read.", "Share this page", "A. Lovelace (1843). Notes."]))
    assert body_lines(page(BODY), text) == [11, 13, 15, 19]


def test_error_page_has_no_body_but_one_slot_does_not_empty_a_page():
    text = "\n".join(lines_of(["Page not found", "Error 404"]))
    assert body_lines(page("<h1>Page not found</h1><p>Error 404</p>"), text) == []
    body = BODY + "<p>{{ staff.title }}</p>"
    text = "\n".join(lines_of(["Ada Lovelace", "Professor", "She works on engines and has written notes about them, which many people read.", "Share this page", "A. Lovelace (1843). Notes.", "{{ staff.title }}"]))
    assert body_lines(page(body), text) == [6, 7, 8, 10, 11]


def test_odd_input(spark):
    assert body_lines(None, "x") == [] and body_lines("<p>x", None) == [] and body_lines("", "") == []
    assert body_lines("<p>only</div></p></b>", "only") == [1]
    rows = spark.createDataFrame([(1, None, None, 1), (2, "<body><p>a b</p></body>", "a b", 2), (2, "<body><p>a b</p></body>", "a b", 2)], "page_id long, html string, text string, line_no int")
    assert sorted(map(tuple, main_lines(rows).collect())) == [(2, 1), (2, 1)]
    assert {tuple(r) for r in main_text(rows).collect()} == {(1, ""), (2, "a b")}
    assert main_lines(rows.limit(0)).count() == 0
    long = "<body><h1>x</h1>" + "".join(f"<p>word {i}</p>" for i in range(3000)) + "</body>"
    assert len(body_lines(long, "\n".join(["x", *(f"word {i}" for i in range(3000))]))) == 3001


PROSE = "".join(f"<p>Sentence {i} of the article says something about engines, looms and the people who built them.</p>" for i in range(30))


def test_heading_elsewhere_only_joins_the_densest_body():
    html = f"<body><div><a href='/1'>Home</a> <a href='/2'>News</a></div><div><h1>Big Site Name</h1></div><div><div><h2>Dr Ada</h2>{PROSE}</div></div><div>Imprint</div></body>"
    text = ["Home News", "Big Site Name", "Dr Ada", *(f"Sentence {i} of the article says something about engines, looms and the people who built them." for i in range(30)), "Imprint"]
    assert body_lines(html, "\n".join(text)) == list(range(2, 34))


def test_heading_right_below_body_takes_neither_notice_nor_teaser():
    html = f"<body><div>We use cookies on this site.</div><h1>Dr Ada</h1>{PROSE}<div class='teaser'><h3>Next event</h3><p>Come and see.</p></div></body>"
    text = ["We use cookies on this site.", "Dr Ada", *(f"Sentence {i} of the article says something about engines, looms and the people who built them." for i in range(30)), "Next event", "Come and see."]
    assert body_lines(html, "\n".join(text)) == list(range(2, 33))
