import pytest

from vellum.llm.residue import residue_kinds

CASES = [
    ("Ada | Uni", "Ada\n{{ staff.title }}\nText", ["slot"]), ("%%FIRST_NAME%% | Uni", "Text", ["slot"]), ("A", "one\n[Your name]", ["slot"]), ("A", "x <?= $email ?>", ["slot"]), ("A", "Contact ${phone_ext}", ["slot"]),
    ("Untitled document", "Some text", ["default_title"]), ("New page (copy)", "Some text", ["default_title"]), ("A", "Lorem ipsum dolor sit amet.", ["filler"]), ("A", "Your text goes here.", ["filler"]),
    ("A", "Page not found", ["error"]), ("A", "Fatal error: Uncaught exception in /x.php on line 3", ["error"]), ("A", "Seite nicht gefunden", ["error"]), ("A", "Please enable JavaScript to continue", ["notice"]),
    ("A", "Students learn to write ${variable} expansions in shell scripts.", []), ("A", "He maintains the {{ }} syntax used by a small template language.", []), ("A", "Her study of “page not found” notices won.", []),
    ("A", "Some features of this site work best with scripts switched on.", []), ("A", "A chapter on lorem ipsum shows how dummy copy shapes page design.", []), ("Untitled document", "", []), (None, None, []), (None, "Plain text [12] [sic]", []),
]


def test_kinds(spark):
    rows = spark.createDataFrame([(i, t, x, "z") for i, (t, x, _) in enumerate(CASES)], "page_id int, title string, text string, other string")
    got = {r["page_id"]: r["residue"] for r in residue_kinds(rows).collect()}
    assert [got[i] for i in range(len(CASES))] == [c[2] for c in CASES]


def test_empty_table_and_long_text(spark):
    rows = spark.createDataFrame([("t", "word " * 200_000 + "\n{{ staff.title }}\n" + "word " * 1000)], "title string, text string")
    assert residue_kinds(rows).first()["residue"] == ["slot"]
    assert residue_kinds(rows.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["residue"])
def test_column_is_replaced(spark, name):
    rows = spark.createDataFrame([("A", "x", "mine")], f"title string, text string, {name} string")
    assert residue_kinds(rows).first()["residue"] == []


FILLER_CASES = [
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.", True),
    ("Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.", True),
    ("Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor invidunt.", True),
    ("Biography: Lorem ipsum dolor sit amet, consectetur adipiscing elit.", True),
    ("She has taught here since 1999. Duis aute irure dolor in reprehenderit in voluptate velit esse cillum.", True),
    ("A chapter on lorem ipsum dolor sit amet shows how dummy copy shapes the design of a printed page.", False),
    ("Her edition of De vita et moribus in honorem magistri est in usum scholarum.", False),
]


def test_filler_by_density(spark):
    from vellum.llm.main_content import is_residue

    rows = spark.createDataFrame([(i, "A", f"Ada\n{x}\nmore") for i, (x, _) in enumerate(FILLER_CASES)], "page_id int, title string, text string")
    got = {r["page_id"]: "filler" in r["residue"] for r in residue_kinds(rows).collect()}
    assert [got[i] for i in range(len(FILLER_CASES))] == [c[1] for c in FILLER_CASES]
    assert [is_residue(x) for x, _ in FILLER_CASES] == [True, True, True, True, False, False, False]  # a line that also has a real sentence stays


LISTING_CASES = [
    ("This course explains the syntax of templates.\n<%= member.role %>\n{{ staff.title }}\nThen the page is shown.", []),
    ("The placeholder stands here:\n{{ staff.title }}\nand is replaced.", []),
    ("Exercise 3\nfunction show(member) {\n  var line = \"{{ staff.title }}\";\n  return line(member);\n}\nHand it in by Friday.", []),
    ("A tutorial:\n" + "{{ staff.title }}\nx = f(1);\n" * 20_000 + "End.", []),
    ("Ada\n{{ staff.title }}\n{{ staff.mail }}\nText", ["slot"]),
    ("She teaches programming.\n{{ staff.title }}\n{{ staff.mail }}\nText", ["slot"]),
    ("A tutorial on templates:\n{{ staff.title }}\nWritten by the group.\nContact {{ staff.mail }} for more", ["slot"]),
]


def test_slots_in_listings_are_discounted(spark):
    rows = spark.createDataFrame([(i, "A", x) for i, (x, _) in enumerate(LISTING_CASES)], "page_id int, title string, text string")
    got = {r["page_id"]: r["residue"] for r in residue_kinds(rows).collect()}
    assert [got[i] for i in range(len(LISTING_CASES))] == [c[1] for c in LISTING_CASES]


PROSE = "\n".join(f"Paragraph {i} of a long article that goes on about the burner, the flask and the scale for quite a while." for i in range(30))
CONTEXT_CASES = [
    ("Greetings\nUse {{ first_name }} to greet the reader, and {{ last_name }} after it.", []),
    ("Exercise\nprint(f\"Hello {name}\")\nRun it.", []),
    ("Manual\nGET /users/:user_id\nThe answer is a list.", []),
    ("Manual\n```\n{{ staff.title }}\n```\nThat was it. The tag `{{ staff.mail }}` too.", []),
    (f"Furnaces\n{PROSE}\nLoading\n{PROSE}", []),
    (f"Titration\n{PROSE}\nWarning: the scale must read zero on line 12", []),
    ("Some University\nLoading", ["notice"]),
    ("Some University\nFatal error: Uncaught exception in /srv/app/x.php on line 12", ["error"]),
    ("Ada\nHer course was moved. {{ first_name }}", ["slot"]),
    ("Ada\n{{ first_name }}: a reader in chemistry.", ["slot"]),
]


def test_context_and_density(spark):
    rows = spark.createDataFrame([(i, "A", x) for i, (x, _) in enumerate(CONTEXT_CASES)], "page_id int, title string, text string")
    got = {r["page_id"]: r["residue"] for r in residue_kinds(rows).collect()}
    assert [got[i] for i in range(len(CONTEXT_CASES))] == [c[1] for c in CONTEXT_CASES]
